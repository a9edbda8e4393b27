import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliospark.llm import encode, language, mix

needs_vocabulary = pytest.mark.skipif(not os.path.exists(encode.BYTE_BPE_50K), reason="no vocabulary files here")
SAMPLES = "/root/testdata/sf0.01/lang_samples.parquet"
TEXTS = ["Hello world", "", None, "  spaces\n\n\ttabs ", "日本語 и русский \U0001f468‍\U0001f52c", "<|endoftext|>", "x" * 5000, "﻿\x00é", "Hello world"]


@needs_vocabulary
def test_ids_equal_a_second_library_and_decode_back(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in encode.encode_ids(df).collect()}
    assert got == {k: other.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    back = {r["doc_id"]: r["text"] for r in encode.decode(encode.encode_ids(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n_tokens"] for r in encode.count_tokens(df.drop("n_tokens"), "doc_id").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert encode.encode_ids(df.limit(0)).count() == 0
    assert encode.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).head()["text"] is None


@needs_vocabulary
def test_offsets_cover_the_text_and_split_characters_share_theirs(spark):
    text = "a 日本 \U0001f52c!"
    row = encode.token_offsets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).head()
    assert row["starts"][0] == 0 and row["ends"][-1] == len(text) and all(a <= b for a, b in zip(row["starts"], row["ends"]))
    assert all(a <= c for a, c in zip(row["starts"], row["starts"][1:]))
    half = row["ids"][: next(k for k, (a, b) in enumerate(zip(row["starts"], row["starts"][1:])) if a == b) + 1]
    assert encode.decode_ids(half).endswith("�")
    table = encode.byte_of_char()
    assert len(table) == 256 and sorted(table.values()) == list(range(256))


def test_quotas_fill_up_and_respect_repeats():
    totals = {"a": 1000, "b": 100, "c": 0}
    q = mix.quotas(totals, {"a": (0.5, 2), "b": (0.4, 3), "c": (0.1, 5)})
    assert q["c"] == 0 and q["b"] == 300 and abs(q["a"] - 800) < 1e-6
    q = mix.quotas(totals, {"a": (0.5, 1), "b": (0.5, 1)}, size=5000)
    assert q == {"a": 1000, "b": 100}
    assert mix.quotas({}, {"a": (1.0, 1)}) == {"a": 0.0} and mix.quotas({}, {}) == {}


def test_the_schedule_stays_within_one_block():
    rng = random.Random(2)
    for _ in range(20):
        blocks = {f"s{k}": rng.choice([0, 1, 7, 50, 300]) for k in range(rng.randint(1, 9))}
        plan = mix.pfair(blocks)
        total = sum(blocks.values())
        assert sorted(plan) == sorted((s, j) for s, n in blocks.items() for j in range(n))
        done = dict.fromkeys(blocks, 0)
        for slot, (s, j) in enumerate(plan, 1):
            assert j == done[s]
            done[s] += 1
            assert all(abs(done[x] - slot * n / total) < 1 for x, n in blocks.items())


@needs_vocabulary
def test_the_mix_keeps_shares_repeats_and_whole_documents(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([" Big ", "big", "small", "none", None]) if i > 3 else "small", " word" * rng.randint(0, 40)) for i in range(400)] + [(None, "big", "x"), (900, "big", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("slot", F.lit("x")).withColumn("block", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 9), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    rows = mix.mix_sources(df, targets, max_blocks=50).collect()
    uses = {}
    for r in rows:
        uses.setdefault(r["doc_id"], []).append(r["copy_no"])
    source = {i: s.strip().lower() for i, s, _ in docs if s and i is not None}
    most = {"big": 1, "small": 3}
    assert all(sorted(c) == list(range(len(c))) and len(c) <= most[source[i]] for i, c in uses.items())
    tokens = {i: len(t.split()) if t else 0 for i, s, t in docs if i is not None}
    size = sum(n for i, n in tokens.items() if source.get(i) in most)
    got = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in most}
    quota = mix.quotas({s: sum(n for i, n in tokens.items() if source.get(i) == s) for s in most}, {"big": (0.5, 1), "small": (0.4, 3), "absent": (0.1, 9)})
    assert all(abs(got[s] - quota[s]) <= 40 for s in most) and abs(sum(got.values()) - size) <= 80
    report = {r["source"]: r for r in mix.shares(df, targets, max_blocks=50).collect()}
    assert set(report) == {"big", "small", "absent"} and report["absent"]["reached_share"] == 0
    assert abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9 and report["small"]["most_repeats"] <= 3
    assert mix.mix_sources(df.limit(0), targets).count() == 0 and mix.mix_sources(df, targets.limit(0)).count() == 0


@pytest.fixture(scope="module")
def samples():
    if not os.path.exists(SAMPLES):
        pytest.skip("no samples here")
    t = pq.read_table(SAMPLES)
    return list(zip(t["lang"].to_pylist(), t["text"].to_pylist()))


def test_held_out_samples_are_recognized(samples):
    held = samples[::4]
    model = language.fit([s for k, s in enumerate(samples) if k % 4])
    scores, _ = model.scores([t for _, t in held])
    right = sum(model.languages[k] == lang for k, (lang, _) in zip(scores.argmax(1), held))
    assert right >= 0.95 * len(held)


def test_presence_counts_each_gram_once_and_never_across_lines():
    rows, buckets, letters = language.presence(["ab", "ab ab", "", "12"])
    assert letters.tolist() == [2, 4, 0, 0]
    assert set(rows.tolist()) == {0, 1} and len({(r, b) for r, b in zip(rows, buckets)}) == len(rows)
    alone = language.presence(["ab"])[1].tolist()
    assert buckets[rows == 0].tolist() == alone


def test_documents_and_lines(spark, samples):
    by = {}
    for lang, t in samples:
        by.setdefault(lang, []).append(t)
    english, german, chinese = ("\n".join(by[x][:6]) for x in ("en", "de", "zh"))
    docs = [(1, english, "en"), (2, english, " EN-us"), (3, english, "de"), (4, german, None), (5, english + "\n\n" + by["de"][7], "en"), (6, chinese, "xx"), (7, None, None), (8, " \n", "en"), (9, "12.5 | 77", None), (10, "Hi", "de")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("language", F.lit("x")).withColumn("letters", F.lit("x"))
    model = language.train(spark.createDataFrame(samples, "lang string, text string"))
    found = language.languages_of(df, model)
    got = {(r["doc_id"], r["line_no"]): r["language"] for r in language.wrong_labels(found).collect()}
    assert got == {(3, 0): "en", (4, 0): "de", (5, 8): "de", (6, 0): "zh"}
    whole = {r["doc_id"]: r for r in found.where("line_no = 0").collect()}
    assert len(whole) == 10 and whole[7]["language"] is None and whole[8]["confidence"] == 0 and whole[9]["language"] is None
    assert all(0 < whole[k]["confidence"] <= 1 for k in (1, 4, 6))
    assert language.languages_of(df.limit(0), model).count() == 0
    empty = language.train(spark.createDataFrame([], "lang string, text string"))
    assert language.languages_of(df, empty).where("language is not null").count() == 0


def short_lines(text):
    """Parts of text of 20 to 40 letters."""
    parts, line = text.split() if " " in text else [text[k : k + 30] for k in range(0, len(text), 30)], ""
    for part in parts:
        line = f"{line} {part}".strip()
        letters = sum(c.isalpha() for c in line)
        if letters >= language.MIN_LETTERS:
            if letters <= 40:
                yield line
            line = ""


def test_short_held_out_lines_stand_out_in_every_other_language(spark, samples):
    model = language.fit([s for k, s in enumerate(samples) if k % 4])
    around = {lang: "\n".join(t for k, (x, t) in enumerate(samples) if x == lang and k % 4) for lang in model.languages}
    held = [(lang, line) for k, (lang, t) in enumerate(samples) if k % 4 == 0 for line in short_lines(t)]
    scores, _ = model.scores([line for _, line in held])
    held = [h for h, s in zip(held, scores) if model.languages[s.argmax()] == h[0]]
    cases = [(lang, line, main) for lang, line in held for main in model.languages if main != lang]
    df = spark.createDataFrame([(k, f"{around[main]}\n{line}", main) for k, (_, line, main) in enumerate(cases)], "doc_id bigint, text string, lang string")
    last = {k: around[main].count("\n") + 2 for k, (_, _, main) in enumerate(cases)}
    found = {r["doc_id"]: r["language"] for r in language.languages_of(df, model).where("line_no > 0").collect() if r["line_no"] == last[r["doc_id"]]}
    right = [found.get(k) == lang for k, (lang, _, _) in enumerate(cases)]
    close = [ok for ok, (lang, _, main) in zip(right, cases) if {lang, main} == {"es", "pt"}]
    assert sum(right) >= 0.975 * len(right) and sum(close) >= 0.9 * len(close)


def test_digests_are_in_no_language(spark, samples):
    english = "\n".join(t for lang, t in samples if lang == "en")
    german = next(t for lang, t in samples if lang == "de")
    digest = "49602ad8c0f098f07441884747d1b721cd701ae3113d397cf4965eb9b21d4437" * 8
    model = language.fit(samples)
    df = spark.createDataFrame([(1, f"{english}\n{digest}\n{german} {digest}", "en")], "doc_id bigint, text string, lang string")
    n = english.count("\n")
    assert [(r["line_no"], r["language"]) for r in language.languages_of(df, model, margin=-9).where(f"line_no > {n + 1}").collect()] == [(n + 3, "de")]


def test_digests_and_encoded_data_have_no_vote(spark, samples):
    german = "\n".join(t for lang, t in samples if lang == "de")
    small = "f1" + "".join("0123456789abcdef"[(7 * k * k + k) % 16] for k in range(9000))
    runs = {1: small, 2: small.upper(), 3: "aB3+/xQ9" * 900, 4: "_-=" * 2000}
    model = language.fit(samples)
    df = spark.createDataFrame([(k, f"{run}\n{german}", "de") for k, run in runs.items()], "doc_id bigint, text string, lang string")
    found = language.languages_of(df, model).collect()
    assert sorted((r["doc_id"], r["line_no"], r["language"]) for r in found) == [(k, 0, "de") for k in runs]
    assert all(r["letters"] == sum(c.isalpha() for c in f"{runs[r['doc_id']]}{german}") for r in found)
    assert language.without_machine_runs("Donaudampfschifffahrtsgesellschaft " + "x" * 40) == "Donaudampfschifffahrtsgesellschaft " + "x" * 40


def test_confidence_is_calibrated_on_held_out_samples(samples):
    assert language.calibrated(samples) in language.SHARPNESSES
    assert language.calibrated(samples[:5]) == language.SHARPNESS
    assert language.calibrated([]) == language.SHARPNESS


def test_cycles_keep_blocks_small_and_every_source_near_its_share(spark):
    blocks, cycles = mix.cycle_of({"a": 900_000.0, "b": 99_000.0, "c": 1_000.0}, block_tokens=100, max_blocks=50)
    assert cycles == 200 and blocks == {"a": 45, "b": 5, "c": 1}
    assert mix.cycle_of({}) == ({}, 0) and mix.cycle_of({"a": 0.0}) == ({}, 0)
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 10 < 7 then 'big' when id % 10 < 9 then 'mid' else 'small' end as source", "repeat('word ', cast(id % 13 as int)) as text")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    made = mix.mix_sources(docs, targets, block_tokens=64, max_blocks=20, bucket_rows=100)
    rows = sorted(made.collect(), key=lambda r: (r["slot"], r["place"]))
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows) and max(r["slot"] for r in rows) > 100
    by, total, at = {}, 0, {}
    for r in rows:
        by[r["source"]] = by.get(r["source"], 0) + r["n_tokens"]
    whole = sum(by.values())
    worst = dict.fromkeys(by, 0.0)
    for r in rows:
        at[r["source"]], total = at.get(r["source"], 0) + r["n_tokens"], total + r["n_tokens"]
        for s in by:
            worst[s] = max(worst[s], abs(at.get(s, 0) - by[s] / whole * total))
    assert all(w <= 2 * 64 + 2 * 13 for w in worst.values())
    seen = {r["source"]: r["most_off"] for r in mix.deviation(made, chunk=7).collect()}
    assert seen.keys() == worst.keys() and all(seen[s] <= worst[s] + 1e-6 for s in worst)
