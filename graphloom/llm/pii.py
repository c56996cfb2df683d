"""Personal information inside free text (problem 10): found by a conditional random field.

The model is trained on the driver from a small labelled table (see ``pii_examples``; at most
``MOST_EXAMPLES`` rows) with the helpful list of given names as one feature among others, and
goes to the tasks as one table of fixed size, with the words that the collection often writes in
lower case. Every text is decoded whole. Findings are then checked for the least form of their
kind and cut to it; nothing is found outside the model.

Defined results: null and empty texts have no findings; positions count Unicode characters
from 0; a document id that occurs twice is searched twice and listed once.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, pick, spread
from graphloom.llm import crf, pii_examples

MOST_EXAMPLES = 8_000
#: Texts that are decoded together.
TOGETHER = 400
@functools.lru_cache(2)
def model(given: frozenset[str], rows: int = MOST_EXAMPLES, tables: int = 2) -> crf.Model:
    """The mean of the weights of models trained on ``tables`` tables of ``rows`` examples, which varies less than one model."""
    names, low = sorted(given), frozenset(g.lower() for g in given)
    parts = [crf.train(pii_examples.labelled(names, seed=5 + k, rows=min(rows, MOST_EXAMPLES)), low) for k in range(tables)]
    return crf.Model(sum(m.w for m in parts) / tables, sum(m.trans for m in parts) / tables, low)


#: Marks that a finding of a kind neither begins nor ends with.
EDGES = {"email": " \t\n\r\xa0,;:.<>()\"'", "phone": " \t\n\r\xa0,;:/-.", "id_number": " \t\n\r\xa0,;:().#", "address": " \t\n\r\xa0,;:()", "name": " \t\n\r\xa0,;:()"}
LEAST_DIGITS = {"phone": 6, "id_number": 4, "address": 1}
#: Words in lower case that a name can hold.
PARTICLES = frozenset("van von der den de del della di da do dos das du la las le los el al ap ben bin ibn ter ten zu zum zur y".split())
_AT = re.compile(r"@|\W\s*\b(?:at|arroba|arobase|ät)\b\s*\W|_at_|\s(?:at|arroba|arobase)\s", re.I)
#: What the part before the @ is made of, and street words whose point belongs to them.
_LOCAL = re.compile(r"[\w.+-]")
_SHORT = re.compile(r"(?:^|[\s.])(?:\w{1,3}|[Bb]lvd|[Aa]vda|[Aa]pdo|[Hh]wy|[Pp]kwy|[Tt]err|[Cc]res|[Gg]dns)\.$")
#: Ten digits in pairs are a telephone number with the 0 of its area code.
_PAIRS = re.compile(r"\d\d(?:[ .-]\d\d){4}")
_OWN_NUMBER = re.compile(r"(?<![^\W_])\d+[^\W\d_]?(?![^\W_])")
_OWN_WORD = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")
_NO_WORD = re.compile(r"[0+(][\d ()/.+-]{8,}")
_GOES_ON = re.compile(r",\s+([^\W\d_])")
_DOT = re.compile(r"\w\.\w|\W(?:dot|punto|point|punkt)\W|_dot_", re.I)


def _pieces(text: str, kind: str, start: int, end: int):
    """A finding; several mail addresses in one are told apart, and one that begins within a word is taken from there on."""
    if kind != "email":
        yield start, end
        return
    while start and _LOCAL.match(text[start - 1]):
        start -= 1
    for part in re.finditer(r"[^,;]+", text[start:end]):
        a, b = start + part.start(), start + part.end()
        if text.count("@", a, b) < 2:
            yield a, b
            continue
        for m in re.finditer(r"[^\s,;<>]+", text[a:b]):
            if "@" in m.group():
                yield a + m.start(), a + m.end()


def checked(text: str, kind: str, start: int, end: int):
    """(start, end) of what a finding holds that has the least form of its kind, without marks at the edges."""
    for a, b in _pieces(text, kind, start, end):
        if kind == "email" and text[a:b].lower().startswith("mailto:"):
            a += 7
        edges = EDGES[kind]
        while b > a and text[b - 1] in edges and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        while a < b and text[a] in edges and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        s = text[a:b]
        if kind in ("name", "address") and s.endswith(".") and not _SHORT.search(s):
            b -= 1  # the point of the sentence, not of an initial or a short form
            s = s[:-1]
        if sum(c.isdigit() for c in s) < LEAST_DIGITS.get(kind, 0) or len(s) < 2:
            continue
        if kind == "email":
            at = _AT.search(s)
            fits = at is not None and _DOT.search(s, at.end() - 1) is not None
        elif kind == "name":
            fits = _like_a_name(text, s, a, b)
        elif kind == "address":
            fits = _like_an_address(s)
        elif kind == "phone":
            fits = _PAIRS.fullmatch(s) is None or s[0] == "0"
        else:
            fits = kind != "id_number" or _labelled(text, a, b)
        if fits:
            yield a, b


def _cues(text: str, a: int, b: int, before: int, after: int) -> list[str]:
    """Classes of the words around a finding; a word of more than 40 characters is no such word."""
    near = re.split(r"[\s:/=]+", text[max(0, a - 40 * before) : a])[-before - 1 :] + re.split(r"[\s:/=]+", text[b : b + 40 * after])[: after + 1]
    return [crf.cue(w.strip("<>()[].,;:\"'#-").lower()) for w in near]


def _labelled(text: str, a: int, b: int) -> bool:
    """A number is personal by a word that says so."""
    return "id" in _cues(text, a, b, 8, 3)


def _like_an_address(s: str) -> bool:
    """A number of its own, of a house, a box or a town, and a word."""
    return _OWN_NUMBER.search(s) is not None and _OWN_WORD.search(s) is not None


def _like_a_name(text: str, s: str, a: int, b: int) -> bool:
    """Words with capitals, particles aside, and none that names an organisation; a comma only where a name is reversed."""
    words = s.split()
    if not words or words[-1].islower() or any(c.isdigit() for c in s) or any(w.strip(",.").islower() and w.strip(",.") not in PARTICLES for w in words):
        return False
    if any(crf.cue(w.strip(",.").lower()) == "org" for w in words):
        return False
    if "," in s and (s.count(",") > 1 or (m := _GOES_ON.match(text, b)) and m.group(1).isupper()):
        return False  # "A, B, C" is a list
    # "the Board of Leeds": after an article, words joined by a particle are a term.
    return all(w[:1].isupper() for w in words) or "det" not in _cues(text, a, a, 1, 0)


def findings(m: crf.Model, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i in range(0, len(texts), TOGETHER):
        part = texts[i : i + TOGETHER]
        for d, kind, s, e in m.spans(part):
            if kind == "address" and _NO_WORD.fullmatch(part[d], s, e):
                kind = "phone"  # digits alone, with the mark of an area code
            out[i + d].extend((kind, a, b) for a, b in checked(part[d], kind, s, e))
    return out


def _given(names: DataFrame) -> frozenset[str]:
    """The helpful list, a small table by definition; it is a feature's vocabulary and goes to every task."""
    return frozenset(r.given_name for r in pick(names, "given_name").where("given_name is not null").distinct().collect())


def common_words(documents: DataFrame) -> frozenset[str]:
    """``crf.common`` of all documents: counted by the tasks, combined before the shuffle; at most ``crf.COUNTED`` words come back."""

    def run(batches):
        for b in batches:
            counts = crf.case_counts([t for t in b.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["w", "low", "n"])

    part = spread(pick(documents, "text")).mapInArrow(run, "w string, low bigint, n bigint")
    sums = keep(part.groupBy("w").agg(F.sum("low").alias("low"), F.sum("n").alias("n")), "words")
    least = crf.least_count(sums.agg(F.sum("n")).first()[0] or 0)
    return frozenset(r.w for r in sums.where((F.col("low") >= least) & (F.col("low") >= crf.LOWER_SHARE * F.col("n"))).select("w").collect())


def _searched(documents: DataFrame, names: DataFrame, out: str, rows_of):
    spark = documents.sparkSession
    m = model(_given(names))
    shared = spark.sparkContext.broadcast((m.w, m.trans, m.given, common_words(documents)))  # ROWS by labels, and COUNTED words at most
    src = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")

    def run(batches):
        mine = crf.Model(*shared.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield rows_of(ids, texts, findings(mine, [t or "" for t in texts]))

    return spread(src).mapInArrow(run, out)


def found(documents: DataFrame, names: DataFrame) -> DataFrame:
    """p10_found: (doc_id, pii_kind, start_pos, end_pos)."""

    def rows_of(ids, texts, got):
        rows = [(d, k, a, b) for d, spans in zip(ids, got) for k, a, b in dict.fromkeys(spans)]
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "pii_kind", "start_pos", "end_pos"])

    return _searched(documents, names, "doc_id bigint, pii_kind string, start_pos bigint, end_pos bigint", rows_of)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` for the findings."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, text, n_found): the readable text with typed placeholders."""

    def rows_of(ids, texts, got):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([masked(t, s) for t, s in zip(texts, got)], pa.string()), pa.array([len(s) for s in got], pa.int64())], names=["doc_id", "text", "n_found"])

    return _searched(documents, names, "doc_id bigint, text string, n_found bigint", rows_of)
