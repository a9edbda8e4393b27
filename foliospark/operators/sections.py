"""Sections of long reports: header marks, candidate screens, spans, scores, the choice of the best span, and the report.

All of it happens inside the row that holds the text: marks are an array of small structs, and screens, spans and scores are
higher-order functions over it. No text is ever shuffled or copied for each mark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions.text import first_above, heads, match_starts, parts_at, running_sums, summarize, trim_ws


def _cut(text: Column, start: Column, length) -> Column:
    return text.substr(start + 1, length if isinstance(length, Column) else F.lit(length))


def in_contents(text: Column, pos: Column, *, share: float = 0.05, radius: int = 250) -> Column:
    """In the first part of the text and near a table of contents."""
    low = F.greatest(pos - radius, F.lit(0))
    return (pos < F.floor(F.length(text) * F.lit(share))) & _cut(text, low, pos + radius - low).rlike(P.CONTENTS)


def cross_reference(text: Column, pos: Column, *, ahead: int = 220) -> Column:
    return _cut(text, pos, ahead).rlike(P.CROSS_REFERENCE)


def relating(text: Column, pos: Column, *, ahead: int = 100) -> Column:
    return _cut(text, pos, ahead).rlike(P.RELATING)


#: More marks than this cannot begin within the radius after another.
_MOST_NEAR = 100


def item_marks(text: Column) -> Column:
    """array<struct<pos, item>>: every place where an item number is named, item in upper case, empty if it is none of 1 to 99C.

    However wide the space between the word and its number is.
    """

    def marks(parts: Column) -> Column:
        named = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.upper(F.regexp_extract(x, P.ITEM_AT_START, 1)))
        lengths = F.transform(parts, F.length)
        return F.transform(F.arrays_zip(running_sums(F.slice(lengths, 1, F.size(lengths) - 1)).alias("pos"), named.alias("item")), lambda m: F.struct(m["pos"].alias("pos"), m["item"].alias("item")))

    return F.when(text.isNotNull(), F.flatten(F.transform(F.array(parts_at(text, P.ITEM_MARK)), marks)))


def nearby_item(text: Column, marks: Column, pos: Column, *, radius: int = 400) -> Column:
    """Whether another item is named wholly inside the radius after pos (the text counts as cut off there)."""
    return F.exists(marks, lambda m: (m["pos"] > pos) & (m["pos"] < pos + radius) & _cut(text, m["pos"], pos + radius - m["pos"]).rlike(P.ITEM_AT_START))


def indexed(text: Column, marks: Column) -> Column:
    """struct<marks, ends...>: the marks with near, and for each label the places that end it, with an index over them.

    With it no mark is compared with all others: near looks at the marks that follow, an end at one block of the places.
    """
    def built(own: Column) -> Column:
        def at(items: tuple[str, ...] | None) -> Column:
            return F.transform(F.filter(own, lambda m: m["item"].isin(*items) if items else m["item"] != ""), lambda m: m["pos"])

        def with_heads(a: Column) -> Column:
            return F.struct(a.alias("at"), heads(a).alias("heads"))

        near = lambda m, i: nearby_item(text, F.slice(own, i + 2, F.lit(_MOST_NEAR)), m["pos"])
        full = F.transform(own, lambda m, i: F.struct(m["pos"].alias("pos"), m["item"].alias("item"), near(m, i).alias("near")))
        ends = {"any": None} | P.ENDERS
        return F.struct(full.alias("marks"), *[F.element_at(F.transform(F.array(at(v)), with_heads), 1).alias(f"ends_{k}") for k, v in ends.items()])

    # Bound as a variable, so that the optimizer does not write it out wherever a part of it is used.
    return F.element_at(F.transform(F.array(marks), built), 1)


def ender(text: Column, index: Column, pos: Column, label: str) -> Column:
    """Where the section that starts at pos ends: its next ender, else the next item, else the end of the text. index: see indexed."""
    own, every = index[f"ends_{label}"], index["ends_any"]
    return F.coalesce(first_above(own["at"], own["heads"], pos), first_above(every["at"], every["heads"], pos), F.length(text))


def _any(text: Column, found: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in found])


def content_score(text: Column, near: Column, start: Column, window: Column, label: str) -> Column:
    """How much a span looks like the section: length, anchors, its opening; less for mentions and lists of items.

    window is the span's text, no more than its first 6,000 code points; near: another item is named right after the start.
    """
    score = F.floor(F.length(window) / 50).cast("int")
    for anchor in P.ANCHORS[label]:
        score = score + F.when(window.rlike(anchor), 200).otherwise(0)
    if label == "1A":
        score = score + F.when(F.substring(window, 1, 300).rlike(r"(?i)\bRisk\s+Factors\b"), 400).otherwise(0)
    if label == "1":
        score = score + F.when(F.substring(window, 1, 300).rlike(r"(?i)\bItem[\s\xA0]*1\b[^\n]{0,120}\bBusiness\b"), 500).otherwise(0)
        score = score - F.when(F.substring(window, 1, 600).rlike(r"(?i)\bBusiness\b"), 0).otherwise(500)
        score = score - F.when(F.substring(window, 1, 800).rlike(r"(?i)\bexecutive officers?\b"), 200).otherwise(0)
    score = score - F.when(near, 500).otherwise(0) - F.when(cross_reference(text, start), 600).otherwise(0)
    line = F.locate("\n", _cut(text, start, 120))
    return score + F.when((line >= 1) & (line <= 81), 120).otherwise(0)


def candidate_starts(text: Column, marks: Column, label: str) -> Column:
    """array<struct<pos, near>> of starts: the strict screens; only where these leave nothing the relaxed ones, for 7A the spelled-out titles.

    marks are those of indexed.
    """
    start = lambda a: F.transform(a, lambda m: F.struct(m["pos"].alias("pos"), m["near"].alias("near")))
    clear = F.filter(start(F.filter(marks, lambda m: m["item"] == label)), lambda m: ~in_contents(text, m["pos"]))
    strict = F.filter(clear, lambda m: ~m["near"])
    if label != "7A":
        strict = F.filter(strict, lambda m: ~cross_reference(text, m["pos"]) & ~relating(text, m["pos"]))
    if label == "1":
        return F.when(F.size(strict) > 0, strict).otherwise(clear)
    if label == "7A":
        titles = F.concat(*[match_starts(text, p) for p in P.ALTERNATIVE_7A])
        titles = F.filter(titles, lambda p: ~in_contents(text, p) & ~nearby_item(text, marks, p))
        return F.when(F.size(strict) > 0, strict).otherwise(F.transform(titles, lambda p: F.struct(p.alias("pos"), F.lit(False).alias("near"))))
    return strict


def candidates(text: Column, index: Column, label: str) -> Column:
    """array<struct<score, len, ord, start, end, anchored>> of the candidate spans, in their order."""
    first = ("(?i)\\bBusiness\\b",) if label == "1" else P.ANCHORS[label]

    # Index, ends and windows are bound in steps of their own: written out, they would be made again for each candidate and anchor.
    def with_window(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["near"].alias("near"), s["end"].alias("end"), s["ord"].alias("ord"), _cut(text, s["start"], F.least(F.lit(6000), s["end"] - s["start"])).alias("w"))

    def scored(s: Column) -> Column:
        anchored = _any(F.substring(s["w"], 1, 5000), first) if label in ("1", "7") else F.lit(False)
        return F.struct(content_score(text, s["near"], s["start"], s["w"], label).alias("score"), (s["end"] - s["start"]).alias("len"), s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"), anchored.alias("anchored"))

    def found(bound: Column) -> Column:
        def span(s: Column, i: Column) -> Column:
            return F.struct(s["pos"].alias("start"), s["near"].alias("near"), ender(text, bound, s["pos"], label).alias("end"), i.alias("ord"))

        return F.transform(F.transform(F.transform(candidate_starts(text, bound["marks"], label), span), with_window), scored)

    return F.flatten(F.transform(F.array(index), found))


def choose(found: Column, label: str, min_chars: int) -> Column:
    """The chosen candidate struct, or null. Ties go to the earlier candidate.

    The best score wins if its span is long enough or alone. Else items 1 and 7 take the longest span that shows an anchor
    early, else the longest; 1A and 7A take the last one if it is longer than the best, else the longest.
    """

    def top(*keys) -> Column:
        ranked = F.transform(found, lambda c: F.struct(*[(c[k].cast("int") if k == "anchored" else c[k]).alias(f"k{j}") for j, k in enumerate(keys)], (-c["ord"]).alias("o"), c.alias("c")))
        return F.array_max(ranked)["c"]

    best = top("score", "len")
    if label in ("1", "7"):
        other = top("anchored", "len", "score")
    else:
        last = F.element_at(found, -1)
        other = F.when(last["len"] > best["len"], last).otherwise(top("len", "score"))
    chosen = F.when((best["len"] >= min_chars) | (F.size(found) == 1), best).otherwise(other)
    return F.when(F.size(found) > 0, chosen)


def with_marks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the array column _marks and the struct column _index over it (see indexed)."""
    return docs.withColumn("_marks", item_marks(F.col(text_col))).withColumn("_index", indexed(F.col(text_col), F.col("_marks")))


def with_spans(docs: DataFrame, *, text_col: str = "text", min_chars: dict[str, int] | None = None, labels: tuple[str, ...] = P.SECTION_LABELS) -> DataFrame:
    """docs with a struct column _span_<label> for each label: score, len, start, end and the number of candidates, or null."""
    least = P.MIN_CHARS | (min_chars or {})
    text = F.col(text_col)
    df = with_marks(docs, text_col)
    for label in labels:
        df = df.withColumn(f"_cand_{label}", candidates(text, F.col("_index"), label))
    for label in labels:
        c = choose(F.col(f"_cand_{label}"), label, least[label])
        df = df.withColumn(f"_span_{label}", F.when(c.isNotNull(), F.struct(c["score"].alias("score"), c["len"].alias("len"), c["start"].alias("start"), c["end"].alias("end"), F.size(f"_cand_{label}").alias("n_candidates"))))
    return df.drop("_marks", "_index", *[f"_cand_{x}" for x in labels])


def find_sections(docs: DataFrame, *keys: str, text_col: str = "text", min_chars: dict[str, int] | None = None) -> DataFrame:
    """(keys, readable, found): for each document the array of its sections with their stripped texts, null where there is none.

    Sections and report both come from it: written once, nothing is searched twice. readable is false for a null text.
    """
    df = with_spans(docs, text_col=text_col, min_chars=min_chars)

    def part(x: str) -> Column:
        s = F.col(f"_span_{x}")
        text = trim_ws(_cut(F.col(text_col), s["start"], s["len"]))
        return F.when(s.isNotNull(), F.struct(F.lit(x).alias("section"), s["start"].alias("start"), s["end"].alias("end"), s["n_candidates"].alias("n_candidates"), s["score"].alias("score"), text.alias("text")))

    return df.select(*keys, F.col(text_col).isNotNull().alias("readable"), F.array(*[part(x) for x in P.SECTION_LABELS]).alias("found"))


def section_rows(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, section, start, end, n_candidates, score, text): the sections of find_sections that are not empty."""
    # An array written out here: over the column itself the optimizer would add a filter on its size and search twice for it.
    out = found.select(*keys, F.explode(F.array(*[F.get("found", F.lit(i)) for i in range(len(P.SECTION_LABELS))])).alias("p")).where("p.text <> ''")
    return out.select(*keys, "p.section", "p.start", "p.end", "p.n_candidates", "p.score", "p.text")


def report_rows(found: DataFrame, *keys: str, min_chars: dict[str, int] | None = None) -> DataFrame:
    """The report of find_sections; see parse_report."""
    least = P.MIN_CHARS | (min_chars or {})
    low = {x: x.lower() for x in P.SECTION_LABELS}
    df = found.select(*keys, "readable", *[F.length(F.get("found", F.lit(i))["text"]).alias(f"_n_{low[x]}") for i, x in enumerate(P.SECTION_LABELS)])
    size = {x: F.col(f"_n_{low[x]}") for x in P.SECTION_LABELS}
    zero = lambda c: F.coalesce(c, F.lit(0))
    any_text = reduce(lambda a, b: a | b, [zero(n) > 0 for n in size.values()])
    read = F.col("readable")
    return df.select(
        *keys,
        F.when(~read, "NO_HTML").when(any_text, "OK").otherwise("NO_SECTIONS").alias("status"),
        *[F.when(read, size[x].isNotNull().cast("int")).alias(f"item_{low[x]}") for x in P.SECTION_LABELS],
        *[F.when(read, zero(size[x])).alias(f"chars_{low[x]}") for x in P.SECTION_LABELS],
        F.when(read, sum((zero(size[x]) for x in P.SECTION_LABELS), F.lit(0))).alias("chars_total"),
        *[F.when(read & size[x].isNotNull(), (size[x] < least[x]).cast("int")).alias(f"short_{low[x]}") for x in P.SECTION_LABELS],
    )


def extract_sections(docs: DataFrame, *keys: str, text_col: str = "text", min_chars: dict[str, int] | None = None) -> DataFrame:
    """(keys, section, start, end, n_candidates, score, text): the stripped text of each section that was found and is not empty.

    A null text has no sections; sections may overlap. The whole report stays in its row until its sections are cut out.
    """
    return section_rows(find_sections(docs, *keys, text_col=text_col, min_chars=min_chars), *keys)


def parse_report(docs: DataFrame, *keys: str, text_col: str = "text", min_chars: dict[str, int] | None = None) -> DataFrame:
    """(keys, status, item_*, chars_*, chars_total, short_*) for each document, whether anything was found or not.

    status is NO_HTML for a null text, NO_SECTIONS if nothing was found, else OK. Flags are 0 or 1 and counts 0 for a section
    that is not there, its short flag is null; all are null for a null text.
    """
    return report_rows(find_sections(docs, *keys, text_col=text_col, min_chars=min_chars), *keys, min_chars=min_chars)


def _named(marks: Column, label: str) -> Column:
    return F.size(F.filter(marks, lambda m: m["item"] == label))


def diagnose(docs: DataFrame, *keys: str, text_col: str = "text", top_k: int | None = 5) -> DataFrame:
    """(keys, label, n_raw, n_candidates, rank, start, span_len, score, preview): the ranked candidates, from 1; all with top_k=None."""
    text = F.col(text_col)
    df = with_marks(docs, text_col)
    per_label = [
        F.struct(F.lit(x).alias("label"), _named(F.col("_marks"), x).alias("n_raw"), candidates(text, F.col("_index"), x).alias("found")) for x in P.SECTION_LABELS
    ]
    df = df.select(*keys, text.alias("_text"), F.explode(F.array(*per_label)).alias("l"))
    ranked = F.array_sort(F.transform("l.found", lambda c: F.struct((-c["score"]).alias("a"), (-c["len"]).alias("b"), c["ord"].alias("o"), c.alias("c"))))
    df = df.select(*keys, "_text", "l.label", "l.n_raw", F.size("l.found").alias("n_candidates"), F.posexplode(ranked if top_k is None else F.slice(ranked, 1, top_k)).alias("rank", "r"))
    preview = summarize(F.col("_text").substr(F.col("r.c.start") + 1, F.least(F.lit(300), F.col("r.c.len"))))
    return df.select(*keys, "label", "n_raw", "n_candidates", (F.col("rank") + 1).alias("rank"), F.col("r.c.start").alias("start"), F.col("r.c.len").alias("span_len"), F.col("r.c.score").alias("score"), preview.alias("preview"))
