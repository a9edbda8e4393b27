import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.llm import lines, nearest, split

CLASH = ["piece_no", "range_no", "part", "text_", "k", "line_no", "word", "bit", "src", "entity", "bucket", "at"]


def with_clashes(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def random_text(rng, n):
    words = ["alpha", "béta", "\U0001f468‍\U0001f52c", "काम", "文章。", "end.", "stop!\n", "\n\n", "x" * 60, "éé", "tab\t", "no break"]
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(words) + rng.choice([" ", " ", ""]))
    return "".join(out)


def check_pieces(text, rows, limit, overlap):
    end = 0
    for k, (no, a, b, piece) in enumerate(sorted(rows)):
        assert no == k and b - a <= limit and text[a:b] == piece
        if k:
            assert end - overlap <= a <= end
        else:
            assert a == 0
        assert b > end or not text
        end = b
    assert end == len(text)


@pytest.mark.parametrize("limit, overlap, span", [(100, 20, 400), (100, 0, 400), (50, 10, 1 << 20)])
def test_pieces_cover_every_text(spark, limit, overlap, span):
    rng = random.Random(limit + span)
    texts = [random_text(rng, n) for n in (0, 10, 99, 100, 101, 500, 3000)] + ["y" * 1234, "", "a" * 100, " " * 333]
    df = with_clashes(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id bigint, text string"))
    got = defaultdict(list)
    for r in split.split_texts(df, limit=limit, overlap=overlap, span=span).collect():
        got[r["doc_id"]].append((r["piece_no"], r["start_pos"], r["end_pos"], r["text"]))
    assert 99 not in got
    for i, t in enumerate(texts):
        check_pieces(t, got[i], limit, overlap)
    bare = split.split_texts(df, limit=limit, overlap=overlap, span=span, with_text=False)
    assert bare.count() == sum(map(len, got.values()))
    assert split.split_texts(df.limit(0)).count() == 0


def test_cuts_prefer_strong_boundaries():
    text = "one two. " * 8 + "\n\n" + "three four. " * 20
    first = split.cut_range(text, 0, len(text), 100, 10)[0]
    assert text[: first[1]].endswith("\n\n")
    text = "word " * 40
    assert all(text[b - 1] == " " for _, b in split.cut_range(text, 0, len(text), 30, 5)[:-1])
    with pytest.raises(ValueError):
        split._check(10, 6, 1000)


def test_family_signs_are_not_cut_apart():
    text = "\U0001f468‍\U0001f52c" * 30
    for _, b in split.cut_range(text, 0, len(text), 10, 2)[:-1]:
        assert text[b] == "\U0001f468"


def test_giant_files_by_ranges(spark, tmp_path):
    rng = random.Random(5)
    bodies = {"a.txt": random_text(rng, 9000).encode(), "b.txt": b"\xff\xfebad " * 300 + "é".encode() * 500, "c.txt": b"short", "d.txt": b""}
    for n, b in bodies.items():
        (tmp_path / n).write_bytes(b)
    pieces = split.split_files(spark, str(tmp_path), limit=100, overlap=20, span=1000)
    rows = defaultdict(list)
    for r in pieces.collect():
        rows[r["path"].rsplit("/", 1)[1]].append(r)
    assert set(rows) == {"a.txt", "b.txt", "c.txt"}
    for name, own in rows.items():
        body = bodies[name]
        text = body.decode("utf-8", "surrogateescape")
        end_byte = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece_no"])):
            assert r["piece_no"] == k and r["n_chars"] <= 100 and r["start_byte"] <= end_byte < r["end_byte"]
            assert text[r["start_char"] : r["start_char"] + r["n_chars"]].encode("utf-8", "surrogateescape") == body[r["start_byte"] : r["end_byte"]]
            end_byte = r["end_byte"]
        assert end_byte == len(body)
    texts = {(r["path"], r["piece_no"]): r["text"] for r in split.read_pieces(pieces).collect()}
    assert len(texts) == sum(map(len, rows.values())) and all(texts.values())


def plain_nearest(points, records, tol):
    out = {}
    for e, t in points:
        if e is None or t is None:
            continue
        best = min(((abs(u - t), u, i) for f, u, i in records if f == e and u is not None and i is not None), default=None)
        if best and best[0] <= tol:
            out[e, t] = best
    return out


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    t0 = dt.datetime(1969, 12, 30)
    when = lambda: t0 + dt.timedelta(seconds=rng.choice([rng.randint(0, 500_000), rng.randint(0, 40) * 3600]), microseconds=rng.choice([0, 0, 1]))
    points = [(rng.choice(["A", "A", "B", None, "Z"]), rng.choice([when(), when(), None])) for _ in range(150)]
    records = [(rng.choice(["A", "B", "C", None]), rng.choice([when(), when(), when(), None]), rng.randint(0, 50)) for _ in range(60)]
    records += records[:10]
    left = with_clashes(spark.createDataFrame(points, "entity string, at timestamp_ntz"))
    right = with_clashes(spark.createDataFrame(records, "entity string, at timestamp_ntz, id bigint"))
    for tol, rings in ((36_000, 4), (3600, 0), (1, 3)):
        got = {(r["entity"], r["at"]): (r["distance_us"], r["id"]) for r in nearest.nearest_by_time(left, right, tolerance_s=tol, rings=rings).collect()}
        want = plain_nearest(points, records, dt.timedelta(seconds=tol))
        assert got == {k: (v[0] // dt.timedelta(microseconds=1), v[2]) for k, v in want.items()}
    assert nearest.nearest_by_time(left.limit(0), right, tolerance_s=10).count() == 0
    assert nearest.nearest_by_time(left, right.limit(0), tolerance_s=10).count() == 0


def test_the_tolerance_is_included_and_ties_go_to_the_earlier_quote(spark):
    d = dt.date(2020, 1, 3)
    mid = dt.datetime(2020, 1, 3)
    h = lambda n: mid + dt.timedelta(hours=n)
    returns = spark.createDataFrame([(1, " ab ", d, None), (1, " ab ", d, None), (2, "cd", d, d), (3, None, d, d), (4, "ef", d, d)], "return_id bigint, ticker string, filing_date date, buy_date date")
    quotes = spark.createDataFrame([(9, "AB", h(36)), (8, "ab", h(-36)), (7, "AB", h(-36)), (5, "CD", h(37)), (6, "EF", h(36) + dt.timedelta(microseconds=1))], "quote_id bigint, ticker string, quoted_at timestamp_ntz")
    assert sorted(map(tuple, nearest.nearest_quotes(returns, quotes).collect())) == [(1, "filing_date", 7)]


def canonical(line):
    return re.sub("[0-9]+", "#", re.sub(r"\s+", " ", line.lower()).strip())


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(1)
    stock = [f"This is the legal notice number {k} of the site" for k in range(6)] + ["short line", "", "THIS  is the LEGAL notice number 77 of the site\r"]
    docs = []
    for i in range(120):
        body = [rng.choice(stock) for _ in range(rng.randint(0, 5))] + [f"a line of its own, number {rng.random()} {chr(97 + i % 26)}{i}x"]
        rng.shuffle(body)
        docs.append((i * 37 - 500, rng.choice(["A", " a", "B", None, "C"]), rng.choice(["\n".join(body)] * 9 + [None])))
    docs += docs[:5]
    df = with_clashes(spark.createDataFrame(docs, "doc_id bigint, ticker string, text string"))
    seen = defaultdict(set)
    for i, t, x in docs:
        for line in (x or "").split("\n"):
            if t is not None and len(canonical(line)) >= 30:
                seen[t.strip().upper(), canonical(line)].add(i)
    want = {(i, n) for i, t, x in docs if t is not None for n, line in enumerate((x or "").split("\n"), 1) if len(seen.get((t.strip().upper(), canonical(line)), ())) >= 6}
    found = lines.repeated_lines(df)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    clean = {r["doc_id"]: r["text"] for r in lines.remove_lines(df, found).collect()}
    for i, _, x in docs:
        assert clean[i] == (None if x is None else "\n".join(line for n, line in enumerate(x.split("\n"), 1) if (i, n) not in want))
    report = {(r["ticker"], r["line"]): r["n_docs"] for r in lines.repeated_line_report(df).collect()}
    assert report == {k: len(v) for k, v in seen.items() if len(v) >= 6}
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_documents_as_files_come_out_whole(spark, tmp_path):
    from foliospark.llm import queries

    text = "One sentence of a long text. " * 700_000  # over two ranges
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.QUERIES["p1_files"](spark, str(tmp_path)).collect(), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in rows] == list(range(len(rows))) and max(r["n_chars"] for r in rows) <= split.LIMIT
    assert rows[0]["start_byte"] == 0 and rows[-1]["end_byte"] == len(text) + 1
    assert all(a["start_byte"] < b["start_byte"] <= a["end_byte"] < b["end_byte"] for a, b in zip(rows, rows[1:]))
