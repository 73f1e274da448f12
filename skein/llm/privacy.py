"""Personal data, and terms that give protected values away, by information-theoretic sanitisation.

Base kinds are matched by their patterns over whole texts. Each matched value is a protected entity. The
corpus then tells how much a term near a value (one of the ``WINDOW`` words on either side) reveals it, with
documents as events:

    PMI(entity, term) = log(documents with the term near the entity * documents / (documents with the entity * documents with the term))

Estimates from few documents are too high, so the PMI is discounted by n / (n + 1) for the n documents with both, and by
m / (m + 1) for the fewer of the entity's and the term's documents, unless the word is formed like a name (a capital inside a sentence, or a
digit), which is evidence of its own. A term whose discounted PMI is at least ``DISCLOSURE`` of the entity's own information, ``log(documents /
documents with the entity)``, discloses it: its occurrences near the entity are spans too. So a plain word discloses a value that it accompanies in
three documents, a name also one that a single document holds, if no other document holds the name. ``SUPPORT`` asks for more documents with both.
``sanitised`` removes values and generalises disclosing terms to their shape.

Cases. Null text: no spans. Null doc_id and repeated rows: each row has its own result and counts as a document. Overlaps: kinds are
independent, so spans of two kinds may overlap; a disclosing term inside a base span is none. Ties at a
threshold disclose. One document alone: no entity has information, so no terms. Very long texts are read whole. An empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import ROW, documents, free_name, materialise, numbered, row_pass, split_words

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of a mention whose disclosure is estimated.
WINDOW = 10
#: Documents in which a term must accompany an entity before the estimate counts.
SUPPORT = 1
#: Share of the entity's information that a term may disclose.
DISCLOSURE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# a run of digits is tried from its first digit only: the later ones end at the same place
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each at-sign back to the start of its local part: linear in the text."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = text.find("@", max(pos, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() <= 60 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entity(kind: str, value: str) -> str:
    return f"{kind}:" + (value.lower() if kind == "email" else re.sub("[^0-9.+]" if kind != "card" else "[^0-9]", "", value))


def neighbours(text: str, spans: list[tuple[str, int, int]], window: int) -> list[dict]:
    """entity, word, start, end, named of the words around each mention that no base span touches: linear in the text and its spans."""
    words = [m.span() for m in _WORD.finditer(text)]
    formed = lambda i: (text[words[i][0]].isupper() and i > 0 and text[words[i - 1][1] - 1] not in ".!?") or any(c.isdigit() for c in text[slice(*words[i])])
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    free, reach, k = [True] * len(words), 0, 0
    order = sorted((a, b) for _, a, b in spans)
    for i, (a, b) in enumerate(words):
        while k < len(order) and order[k][0] < b:  # the furthest end of the spans that begin before the word's end
            reach = max(reach, order[k][1])
            k += 1
        free[i] = reach <= a
    out = []
    for kind, a, b in spans:
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        entity = _entity(kind, text[a:b])
        out += [{"entity": entity, "word": text[starts[i] : ends[i]], "start": starts[i], "end": ends[i], "named": formed(i)} for i in (*range(max(0, before - window), before), *range(after, min(after + window, len(words)))) if free[i]]
    return out


def find_base(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Base spans and the words near them of every row. docs: uid, doc_id, text."""

    def maker():
        def make(texts):
            found = [base_spans(t) if t else [] for t in texts]
            near = [neighbours(t, s, window) if s else [] for t, s in zip(texts, found, strict=True)]
            return [[k for k, _, _ in s] for s in found], [[a for _, a, _ in s] for s in found], [[b for _, _, b in s] for s in found], near

        return make

    fields = "kinds array<string>, starts array<int>, ends array<int>, near array<struct<entity:string,word:string,start:int,end:int,named:boolean>>"
    return row_pass(docs, ["text"], fields, maker, ["uid", "doc_id"])


def as_term(word: Column) -> Column:
    """A word in lower case without the marks around it."""
    return F.regexp_replace(F.lower(word), r"^[.,;:!?\"'()\[\]]+|[.,;:!?\"'()\[\]]+$", "")


def near_terms(found: DataFrame) -> DataFrame:
    """uid, entity, term, start, end, named of the words of two characters or more near each mention. found: from ``find_base``."""
    return found.select("uid", F.inline("near")).select("uid", "entity", as_term(F.col("word")).alias("term"), "start", "end", "named").where(F.length("term") > 1)


def document_terms(docs: DataFrame) -> DataFrame:
    """One row (term) for each document and distinct term."""
    return docs.select(F.explode(F.array_distinct(F.transform(split_words(F.col("text")), as_term))).alias("term"))


def disclosing_terms(found: DataFrame, terms: DataFrame, n_docs: int, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """entity, term, pmi (discounted), information of the terms over the threshold.

    found: from ``find_base``. terms: one row (term) for each document and distinct term of it, counted in each task before
    it meets the candidates, so the join sees a row a term; read only where there are candidates. Candidates are
    at most 2 * WINDOW a mention.
    """
    once = near_terms(found).groupBy("uid", "entity", "term").agg(F.bool_or("named").alias("named"))
    pairs = once.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.bool_or("named").alias("named")).where(F.col("n_both") >= support)
    entities = found.select("uid", F.inline("near")).select("uid", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = F.lit(float(n_docs))
    information = F.log(n / F.col("n_entity"))
    both = materialise(pairs.join(entities, "entity").where(information > 0), "accompanying")
    if not both.limit(1).count():
        return both.select("entity", "term", F.lit(0.0).alias("pmi"), F.lit(0.0).alias("information")).limit(0)
    wanted = materialise(both.select("term").distinct(), "terms")
    held = materialise(terms.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term"), "term-documents")
    fewer = F.least("n_entity", "n_term")
    discount = F.col("n_both") / (F.col("n_both") + 1) * F.when(F.col("named"), 1.0).otherwise(fewer / (fewer + 1))
    pmi = discount * F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    return (
        both.join(held, "term").select("entity", "term", pmi.alias("pmi"), information.alias("information"))
        .where(F.col("pmi") >= disclosure * F.col("information"))
    )


def personal_spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """uid, doc_id and the base and term spans of each row of ``docs`` (doc_id, text)."""
    uid = F.col(ROW).alias("uid") if ROW in docs.columns else F.monotonically_increasing_id().alias("uid")
    base = docs.select(uid, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(find_base(base), "personal")
    terms = materialise(disclosing_terms(found, document_terms(base), found.count(), support, disclosure), "disclosing")
    extra = (
        near_terms(found).join(terms.select("entity", "term"), ["entity", "term"], "left_semi")
        .groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    )
    return found.drop("near").join(extra, "uid", "left")


def op4_information_sanitise(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document, under the production thresholds."""
    found = personal_spans(documents(spark, sf_dir, "doc_id", "text"))
    at = F.transform(
        F.arrays_zip("kinds", "starts", "ends"),
        lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")),
    )
    term = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(F.array_join(at, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(at, F.coalesce(term, F.array().cast("array<string>"))), ",").alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
    )


def sanitised(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with values replaced by their kind and disclosing terms by their shape (``[Name]``, ``[number]``, ``[word]``)."""
    rows = numbered(docs)
    held, clean = free_name(docs, "held"), free_name(docs, "clean")
    spans = personal_spans(rows, support, disclosure).select(F.col("uid").alias(ROW), F.struct("kinds", "starts", "ends", "terms").alias(held))

    def maker():
        def one(t, of):
            cuts = [(a, b, f"[{k.upper()}]") for k, a, b in zip(of["kinds"], of["starts"], of["ends"], strict=True)]
            for s in of["terms"] or []:
                word = t[s["start"] : s["end"]]
                cuts.append((s["start"], s["end"], "[Name]" if word[:1].isupper() else "[number]" if word[:1].isdigit() else "[word]"))
            out, pos = [], 0
            for a, b, mark in sorted(cuts):
                if a >= pos:
                    out += [t[pos:a], mark]
                pos = max(pos, b)
            return "".join(out) + t[pos:]

        return lambda texts, spans: [[None if t is None else one(t, s) for t, s in zip(texts, spans, strict=True)]]

    found = row_pass(rows.join(spans, ROW), ["text", held], f"{clean} string", maker, [c for c in docs.columns if c != "text"])
    return found.select(*(F.col(f"`{clean}`").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
