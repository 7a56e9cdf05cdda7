"""Fragments of a text around matched terms; for the few hits that are shown."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr jr sr vs etc inc st prof capt co ltd gen".split())
CLOSERS = frozenset("\"')]}”’")
Match = tuple[int, int, str]


@dataclass(frozen=True)
class FragmentConfig:
    window: int = 40
    pre: str = "<b>"
    post: str = "</b>"
    most: int = 5
    sentences: bool = False


def sentence_starts(text: str) -> list[int]:
    out = [0]
    for i, c in enumerate(text):
        if c not in ".!?":
            continue
        if c == ".":
            j = i
            while j and text[j - 1].isalpha():
                j -= 1
            # letters behind a digit are an ordinal's, not an abbreviation
            if text[j:i].lower() in ABBREVIATIONS and not (j and text[j - 1] in "0123456789"):
                continue
        k = i + 1
        while k < len(text) and text[k] in CLOSERS:
            k += 1
        while k < len(text) and text[k].isspace():
            k += 1
        if k < len(text) and text[k].isupper():
            out.append(k)
    return sorted(set(out))


def _merged(parts: Iterable[tuple[int, int, list[Match]]]) -> list[tuple[int, int, list[Match]]]:
    out: list[tuple[int, int, list[Match]]] = []
    for a, b, m in parts:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + m)
        else:
            out.append((a, b, m))
    return out


def fragments(text: str, spans: Sequence[Match], config: FragmentConfig = FragmentConfig()) -> list[tuple[str, list[str]]]:
    """(marked text, matched terms) left to right; windows are widened to white space, those that meet become one."""
    n = len(text)
    matches = sorted(((a, min(b, n), t) for a, b, t in spans if 0 <= a <= b and a <= n), key=lambda m: m[0])
    if not text or not matches:
        return []
    windows = []
    for m in matches:
        a, b = max(0, m[0] - config.window), min(n, m[1] + config.window)
        while a and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        windows.append((a, b, [m]))
    parts = _merged(windows)
    if config.sentences:
        starts = sentence_starts(text)
        whole = []
        for _, _, ms in parts:
            first, last = min(m[0] for m in ms), max(m[1] for m in ms)
            a = max(s for s in starts if s <= first)
            b = next((s for s in starts if s >= last and s > a), n)
            whole.append((a, max(a, len(text[:b].rstrip()) if b < n else b), ms))
        parts = _merged(whole)
    return [_rendered(text, p, config) for p in parts[: config.most]]


def _rendered(text: str, part: tuple[int, int, list[Match]], config: FragmentConfig) -> tuple[str, list[str]]:
    a, b, matches = part
    out, at = [], a
    terms: list[str] = []
    for s, e, t in matches:
        if t not in terms:
            terms.append(t)
        if s >= at and e <= b:
            out += [text[at:s], config.pre, text[s:e], config.post]
            at = e
    return "".join([*out, text[at:b]]), terms


def matched_offsets(postings: DataFrame, field: str, terms: Sequence[str]) -> DataFrame:
    """doc_id, term, start, end of the given terms, where offsets are kept."""
    rows = postings.filter((F.col("field") == field) & F.col("term").isin(*terms))
    return rows.select("doc_id", "term", F.inline(F.arrays_zip("starts", "ends"))).select("doc_id", "term", F.col("starts").alias("start"), F.col("ends").alias("end"))


def highlight(hits: DataFrame, docs: DataFrame, postings: DataFrame, field: str, column: str, terms: Sequence[str], config: FragmentConfig = FragmentConfig()) -> DataFrame:
    """doc_id, fragments (array of text, matched_terms) for the hits, which should be few."""
    spans = matched_offsets(postings, field, terms).join(hits.select("doc_id"), "doc_id", "left_semi")
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "term"))).alias("spans"))
    rows = docs.select("doc_id", F.col(column).alias("text")).join(spans, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [fragments(t or "", [(s["start"], s["end"], s["term"]) for s in x], config) for t, x in zip(b["text"], b["spans"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fragments": [[{"text": t, "matched_terms": m} for t, m in f] for f in found]})

    return rows.mapInPandas(run, "doc_id long, fragments array<struct<text:string,matched_terms:array<string>>>")
