"""The section operators against a plain reading of their rules, one text at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.operators import sections as S

ITEM = re.compile(r"\bItem[\s\xa0]*(?=[0-9])", re.I)


def mark_list(text):
    out = []
    for m in ITEM.finditer(text):
        found = re.match(r"Item[\s\xa0]*([0-9]{1,2}[A-C]?)\b", text[m.start() : m.start() + 80], re.I)
        out.append((m.start(), found.group(1).upper() if found else ""))
    return out


def near(text, marks, pos):
    return any(pos < p < pos + 400 and re.match(r"Item[\s\xa0]*[0-9]{1,2}[A-C]?\b", text[p : pos + 400], re.I) for p, _ in marks)


def toc(text, pos):
    return pos < int(len(text) * 0.05) and re.search(P.CONTENTS, text[max(0, pos - 250) : pos + 250]) is not None


def cross(text, pos):
    return re.search(r"(?i)\b(see|refer to|as discussed in)\b|(?:of|in)\s+Part\s+[IVXLC]+\b", text[pos : pos + 220]) is not None


def score(text, marks, a, b, label):
    w = text[a : min(a + 6000, b)]
    out = len(w) // 50 + 200 * sum(bool(re.search(p, w)) for p in P.ANCHORS[label])
    if label == "1A":
        out += 400 * bool(re.search(r"(?i)\bRisk\s+Factors\b", w[:300]))
    if label == "1":
        out += 500 * bool(re.search(r"(?i)\bItem[\s\xa0]*1\b.{0,120}\bBusiness\b", w[:300]))
        out -= 500 * (not re.search(r"(?i)\bBusiness\b", w[:600])) + 200 * bool(re.search(r"(?i)\bexecutive officers?\b", w[:800]))
    out -= 500 * near(text, marks, a) + 600 * cross(text, a)
    return out + 120 * (0 <= text[a : a + 120].find("\n") <= 80)


def span_of(text, label, least):
    marks = mark_list(text)
    own = [p for p, i in marks if i == label and not toc(text, p)]
    strict = [p for p in own if not near(text, marks, p)]
    if label != "7A":
        strict = [p for p in strict if not cross(text, p) and not re.search(P.RELATING, text[p : p + 100])]
    starts = strict or (own if label == "1" else [])
    if not starts and label == "7A":
        titles = [m.start() for p in P.ALTERNATIVE_7A for m in re.finditer(p, text)]
        starts = [p for p in titles if not toc(text, p) and not near(text, marks, p)]
    if not starts:
        return None

    def end(p):
        ends = [q for q, i in marks if q > p and i in P.ENDERS[label]]
        return min(ends) if ends else min([q for q, i in marks if q > p and i] or [len(text)])

    found = [(score(text, marks, p, end(p), label), end(p) - p, -k, p) for k, p in enumerate(starts)]
    best = max(found)
    if best[1] >= least or len(found) == 1:
        return best[3], end(best[3])
    if label in ("1", "7"):
        anchors = [r"(?i)\bBusiness\b"] if label == "1" else P.ANCHORS["7"]
        shown = [c for c in found if any(re.search(a, text[c[3] : min(c[3] + 5000, end(c[3]))]) for a in anchors)] or found
        p = max((c[1], c[0], c[2], c[3]) for c in shown)[3]
    else:
        p = starts[-1] if end(starts[-1]) - starts[-1] > best[1] else max((c[1], c[0], c[2], c[3]) for c in found)[3]
    return p, end(p)


def random_report(rng):
    parts = []
    for _ in range(rng.randint(1, 14)):
        parts.append(rng.choice(["Item 1", "ITEM 1A.", "Item\n1A", "Item\xa07", "Item 7A", "Item 8", "item 2", "Item 1 A", "Item 10", "Item 123", "Quantitative and Qualitative Disclosures About Market Risk", "Table of Contents", "Item 1Item 2"]))
        parts.append(rng.choice([" Business", " Risk Factors", ". Results of Operations", " related to sales", " see Part II", "\n", " executive officers"]))
        parts.append(rng.choice([" x" * rng.randint(0, 60), " word" * rng.randint(50, 400), "\U0001f4c8é\n" * rng.randint(0, 150)]))
    return "".join(parts)


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_the_plain_reading(spark, seed):
    rng = random.Random(seed)
    least = {"1": 900, "1A": 700, "7": 900, "7A": 300}
    texts = [random_report(rng) for _ in range(60)] + ["", "Item 7", "no headers at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = S.with_spans(df, min_chars=least).collect()
    for row in got:
        for label in P.SECTION_LABELS:
            want = span_of(texts[row["k"]], label, least[label])
            s = row[f"_span_{label}"]
            assert (None if s is None else (s["start"], s["end"])) == want, (seed, row["k"], label)


def test_nearby_is_cut_off_at_the_radius(spark):
    # At 394 the radius cuts the number to one digit, which still is an item; at 395 nothing of it is left.
    for gap, want in ((393, True), (394, True), (395, False), (399, False)):
        df = spark.createDataFrame([("Item 1".ljust(gap) + "Item 10",)], "text string")
        got = df.select(S.nearby_item(F.col("text"), S.item_marks(F.col("text")), F.lit(0))).head()[0]
        assert got is want, gap


def test_report_and_sections_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Item 7. Results of Operations\nwent well")], "k int, text string")
    rows = {r["k"]: r for r in S.parse_report(df, "k").collect()}
    assert [rows[k]["status"] for k in (1, 2, 3)] == ["NO_HTML", "NO_SECTIONS", "OK"]
    assert rows[1]["item_7"] is None and rows[2]["item_7"] == 0 and rows[2]["short_7"] is None
    assert (rows[3]["item_7"], rows[3]["chars_7"], rows[3]["short_7"], rows[3]["chars_total"]) == (1, 39, 1, 39)
    found = S.extract_sections(df, "k").collect()
    assert [(r["k"], r["section"], r["text"]) for r in found] == [(3, "7", "Item 7. Results of Operations\nwent well")]


def test_diagnose_ranks_from_one(spark):
    text = "Item 7 a\n" + "w " * 500 + "Item 7 Liquidity and Capital Resources\n" + "v " * 500
    rows = S.diagnose(spark.createDataFrame([(1, text)], "k int, text string"), "k").where("label = '7'").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["start"] > 0 and rows[0]["n_raw"] == 2
