"""Personal data: fixed patterns, and spans that a character-level BiLSTM-CRF adds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.bilstm import KINDS, Tagger, encode_chars, example_windows, train
from revcast.llm.common import whole_text

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WINDOW = 512
OVERLAP = 64
BATCH_CHARS = 900_000
FORM = {"ip": re.compile(r"[0-9. ]+"), "card": re.compile(r"[0-9 .-]+"), "phone": re.compile(r"[0-9 ().+/-]+")}
LEAST_DIGITS = {"ip": 4, "card": 12, "phone": 7}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind by its pattern: leftmost, not overlapping; failing matches are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = [m.span() for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def plausible(kind: str, text: str) -> bool:
    """Whether a span that only the model sees has what any datum of its kind has."""
    if kind == "email":
        return any(mark in text for mark in ("@", "[at]", "(at)")) and "." in text
    return FORM[kind].fullmatch(text) is not None and sum(c.isdigit() for c in text) >= LEAST_DIGITS[kind]


def windows_of(length: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows over a text."""
    step = WINDOW - OVERLAP
    return [(s, min(length, s + WINDOW)) for s in range(0, max(1, length - OVERLAP), step)] if length else []


def reconciled(spans: list[tuple[int, int, int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of a whole text from those of its windows (kind, start, end, window start, window end).

    A span counts where its middle lies in the core of the window that saw it, so each place has one
    window to decide; touching or overlapping spans of one kind join, of two kinds the longer stays.
    """
    half = OVERLAP // 2
    own = []
    for kind, s, e, ws, we in spans:
        low, high = ws + (half if ws else 0), we - (half if we < length else 0)
        if low <= (s + e) / 2 < high or (we == length and (s + e) / 2 >= low):
            own.append((s, e, kind))
    out: list[tuple[int, int, int]] = []
    for s, e, kind in sorted(own):
        if out and s <= out[-1][2] and kind == out[-1][0]:
            out[-1] = (kind, out[-1][1], max(e, out[-1][2]))
        elif out and s < out[-1][2]:
            if e - s > out[-1][2] - out[-1][1]:
                out[-1] = (kind, s, e)
        else:
            out.append((kind, s, e))
    return out


def all_spans(texts: list[str], tagger: Tagger) -> list[dict[str, tuple[list, list]]]:
    """For each text kind -> (base spans, spans the model adds)."""
    jobs, chars = [], []
    for d, text in enumerate(texts):
        codes = encode_chars(text)
        for s, e in windows_of(len(text)):
            jobs.append((d, s, e))
            chars.append(codes[s:e])
    seen: list[list] = [[] for _ in texts]
    for (d, s, e), spans in zip(jobs, tagger.spans(chars), strict=True):
        seen[d].extend((kind, s + a, s + b, s, e) for kind, a, b in spans)
    out = []
    for text, spans in zip(texts, seen, strict=True):
        base = base_spans(text)
        taken = sorted(x for own in base.values() for x in own)
        added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        for kind, s, e in reconciled(spans, len(text)):
            body = text[s:e]
            s, e = s + len(body) - len(body.lstrip()), e - (len(body) - len(body.rstrip()))
            if s < e and plausible(KINDS[kind], text[s:e]) and not any(a < e and s < b for a, b in taken):
                added[KINDS[kind]].append((s, e))
        out.append({k: (base[k], added[k]) for k in KINDS})
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of few characters each, so that the model's arrays stay small."""
    texts = batch.column("text")
    start = size = 0
    for i in range(batch.num_rows):
        n = len(texts[i].as_buffer() or b"")
        if i > start and size + n > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _span_step(tagger: Tagger):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _chunks(batch):
                found = all_spans(some.column("text").to_pylist(), tagger)
                rows = [
                    [{"kind": k, "start": s, "end": e, "base": base} for k in KINDS for s, e, base in sorted([(*x, True) for x in own[k][0]] + [(*x, False) for x in own[k][1]])]
                    for own in found
                ]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
                keep = [n for n in some.schema.names if n != "text"]
                yield pa.record_batch([*[some.column(n) for n in keep], pa.array(rows, kind)], names=[*keep, "spans"])

    return step


def _mask_step(tagger: Tagger):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _chunks(batch):
                texts = some.column("text").to_pylist()
                clean = []
                for text, own in zip(texts, all_spans(texts, tagger), strict=True):
                    parts, at = [], 0
                    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in own[k][0] + own[k][1]):
                        if e <= at:
                            continue
                        parts += [text[at : max(at, s)], f"<{k}>"]
                        at = e
                    clean.append("".join([*parts, text[at:]]))
                names = [n for n in some.schema.names if n != "text"]
                yield pa.record_batch([*[some.column(n) for n in names], pa.array(clean, pa.string())], names=[*names, "text"])

    return step


def trained_tagger(docs: DataFrame, sample_docs: int = 1200, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """The model, trained on the driver on windows of at most ``sample_docs`` documents.

    The sample is the documents of the smallest id hashes; windows of about 100 characters are cut from them in
    the tasks.  Their labelled spans are those of the patterns, and data written in other forms (no
    country code, spelt-out at sign, grouped digits) put into the same windows.  The size of the
    sample is the bound; the model then runs over every character of every row.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    schema = "doc_id long, at int, text string, labels array<struct<kind: int, start: int, end: int>>"
    rows = picked.mapInArrow(example_windows(base_spans), schema).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "text").limit(4 * sample_docs).collect()
    return train([(r["text"], [tuple(x) for x in r["labels"]]) for r in rows], seed)


def spans(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>> of every whole text, in code points, end exclusive.

    Null and empty texts have no spans; a text of any length is cut in overlapping windows; rows are
    independent, so repeated rows and null ids keep their rows; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_span_step(tagger), "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


def masked(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; null texts stay null, other columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    rows = docs.toDF(*names).select(*[n for i, n in enumerate(names) if i != at], F.col(names[at]).isNull().alias("void"), whole_text(names[at]).alias("text"))
    clean = rows.mapInArrow(_mask_step(tagger), rows.schema)
    back = [F.when(~F.col("void"), F.col("text")) if i == at else F.col(n) for i, n in enumerate(names)]
    return clean.select(*[c.alias(n) for c, n in zip(back, docs.columns, strict=True)])
