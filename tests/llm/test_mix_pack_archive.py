"""Mixing, packing, archives and the pipeline: sums, exact round trips, plans against bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import mixing, packing, pii, quality, simhash, warc
from tests.llm.helpers import awkward, docs, empty
from tests.llm.test_copies_and_prints import brute_groups


def water_fill(sizes, share=1.5, limit=2.0):
    """Targets by the rule as it is written: cap, share the excess by weight, again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = total
    while left > 1e-6 and open_:
        part = left / sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += part * weight[s]
        left = 0.0
        for s in list(open_):
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_its_targets(spark):
    rnd = random.Random(1)
    texts = [("w " * rnd.choice([0, 1, 5, 40, 300]), rnd.choice(["a", "b", "c", "é", "Z", None, "big", "big", "big"])) for _ in range(900)]
    frame = docs(spark, texts)
    got = mixing.mixed(frame).collect()
    assert len(got) == 900
    source = {i: s for i, (_, s) in enumerate(texts)}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(texts[r.doc_id][0].split()) and 0 <= r.taken <= 2 * r.size
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    want = water_fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= 1
        parts = [r for r in got if source[r.doc_id] == s and r.size and r.taken % r.size]
        assert len(parts) <= 1  # all but one are taken whole
    assert sorted(map(tuple, mixing.mixed(frame.repartition(5)).collect())) == sorted(map(tuple, got))  # reruns agree


def test_pivots_keep_expectations(spark):
    """A document's expected words are its source's rate times its size, whatever the size."""
    texts = [("w " * (3 + i % 5), "a") for i in range(4000)] + [("w " * 4, "b") for _ in range(4000)]
    got = mixing.mixed(docs(spark, texts)).collect()
    for low, high in ((0, 4000), (4000, 8000)):
        mine = [r for r in got if low <= r.doc_id < high]
        rate = mine[0].target / mine[0].source_size
        assert 0 < rate < 2 and rate % 1 > 0.05
        for size in {r.size for r in mine}:
            taken = [r.taken / size for r in mine if r.size == size]
            assert len(taken) >= 800 and abs(sum(taken) / len(taken) - rate) < 0.06
            assert len(set(taken)) == 2 or len(taken) - len([t for t in taken if t % 1 == 0]) <= 1


def test_equal_rows_are_mixed_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL", 7)
    same = spark.createDataFrame([(1, "w " * 10, "a")] * 200 + [(None, "v " * 5, "a")] * 200 + [(i, "u " * 8, "b") for i in range(10, 60)], "doc_id long, text string, source string")
    got = mixing.mixed(same).collect()
    assert len(got) == 450 and sorted(map(tuple, mixing.mixed(same.repartition(6)).collect()), key=str) == sorted(map(tuple, got), key=str)
    for of in ({1, None}, set(range(10, 60))):
        mine = [r for r in got if r.doc_id in of]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert {r.taken for r in got if r.doc_id == 1} >= {10, 20}  # equal rows are not all alike


def test_mix_on_awkward_rows(spark):
    got = mixing.mixed(awkward(spark)).collect()
    assert len(got) == 8 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mixed(empty(spark)).count() == 0
    blank = mixing.mixed(docs(spark, [None, "", " "])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 3


def test_remix_repeats_rows_as_marked(spark):
    rnd = random.Random(3)
    texts = [(" ".join(f"x{i}y{j}" for j in range(rnd.randint(1, 30))), rnd.choice("abc")) for i in range(200)] + [(None, "a"), ("same text", "b")]
    frame = docs(spark, texts)
    frame = frame.unionByName(frame.where("doc_id = 201")).unionByName(frame.where("doc_id = 201"))
    marks = defaultdict(int)
    for r in mixing.mixed(frame).collect():
        marks[r.doc_id] += r.taken
    out = mixing.remix(frame)
    assert out.columns == frame.columns
    words = defaultdict(int)
    for r in out.collect():
        assert r.n_chars == len(r.text) and texts[r.doc_id][0].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in marks.items() if v} == dict(words)
    assert mixing.remix(awkward(spark)).columns == awkward(spark).columns
    assert mixing.remix(empty(spark)).count() == 0


def test_knapsack_matches_brute_force():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        sizes = np.unique(rnd.integers(1, 20, 5))
        values = rnd.random(len(sizes))
        price, counts = packing.knapsack(sizes, values, 23)
        best = np.zeros(24)
        for room in range(1, 24):
            best[room] = max([best[room - 1]] + [best[room - s] + v for s, v in zip(sizes, values) if s <= room])
        assert price == pytest.approx(best[23]) and counts @ sizes <= 23 and counts @ values == pytest.approx(price)


def test_plans_place_all_items_near_the_bound():
    rnd = random.Random(6)
    for _ in range(8):
        histogram = {rnd.randint(1, 256): rnd.randint(0, 400) for _ in range(60)}
        made = packing.plan(histogram)
        placed = defaultdict(int)
        for held, n in made:
            assert sum(s * k for s, k in held.items()) <= 256
            for s, k in held.items():
                placed[s] += k * n
        assert {s: n for s, n in histogram.items() if n} == dict(placed)
        lower = sum(u for _, u in packing.relax(*map(np.array, zip(*sorted((s, n) for s, n in histogram.items() if n))), 256))
        assert sum(n for _, n in made) <= lower * 1.02 + 8
    assert packing.plan({}) == []


def check_packing(frame, rows):
    encode = packing.Encoder(packing.tokenizer_path())
    ids = defaultdict(list)
    for r in frame.select("doc_id", "text").collect():
        ids[r.doc_id].append(encode.ids(r.text))
    at, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and r.doc_tokens * 4 in {len(x) for x in ids[r.doc_id]}
        assert any(zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in ids[r.doc_id])
        at[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for doc, copies in ids.items():
        if len(copies) == 1:
            end = 0
            for start, length in sorted(at[doc]):
                assert start == end
                end += length
            assert end * 4 == len(copies[0])
        else:
            assert sum(n for _, n in at[doc]) * 4 == sum(map(len, copies))
    padding = 0
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    return padding, sum(sum(map(len, v)) // 4 for v in ids.values())


def test_packing_is_an_exact_cover_with_little_padding(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.packed(frame).collect()
    padding, tokens = check_packing(frame, rows)
    assert padding < 0.02 * tokens
    assert sorted(map(tuple, packing.packed(frame.repartition(6)).collect())) == sorted(map(tuple, rows))


def test_packing_of_awkward_rows(spark):
    check_packing(awkward(spark), packing.packed(awkward(spark)).collect())
    assert packing.packed(empty(spark)).count() == 0


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2)
    texts = [" ".join(f"{i}x{j}" for j in range(40)) for i in range(1500)]
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    held = frame.select("doc_id", F.xxhash64("text").alias("salt")).where(packing._unit(1) < 0.1).withColumn("g", F.floor(packing._unit(3) * 5))
    sizes = [r["count"] for r in held.groupBy("g").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 60
    check_packing(frame, packing.packed(frame).collect())


def test_packing_when_nothing_fits_together(spark):
    frame = docs(spark, [" ".join(f"{i}" for _ in range(2400)) for i in range(10, 50)])  # all just over half a sequence
    padding, tokens = check_packing(frame, packing.packed(frame).collect())
    assert padding < 0.25 * tokens


def test_packing_of_short_texts_goes_by_the_plan(spark, monkeypatch):
    shares, groups = [], []
    share_of, groups_of = packing.held_share, packing.groups_for
    monkeypatch.setattr(packing, "held_share", lambda slack: shares.append(share_of(slack)) or shares[-1])
    monkeypatch.setattr(packing, "groups_for", lambda *a: groups.append(groups_of(*a)) or groups[-1])
    monkeypatch.setattr(packing, "GROUP", 2)
    frame = docs(spark, ["one two three four five six seven eight"[: 4 + i % 36] for i in range(6000)])
    rows = packing.packed(frame).collect()
    padding, tokens = check_packing(frame, rows)
    assert padding < packing.CAPACITY and shares[0] < 0.1  # what one sequence has left, at most
    assert groups[0] >= tokens // packing.CAPACITY // 2
    for unit in (1, 2, 4, 8, 16):
        sizes = [packing.size_of(n, unit) for n in range(1, 4097)]
        assert sizes == sorted(sizes) and all(n <= s * unit < n + 16 for n, s in enumerate(sizes, 1)) and sizes[-1] == 4096 // unit
    assert packing.held_share(0.002) == pytest.approx(0.015) and packing.held_share(0.5) < 0.6
    assert packing.groups_for(0, 10 * packing.GROUP * packing.CAPACITY) == 10


@pytest.mark.parametrize("lengths", [{129 * 16: 300}, {150 * 16: 150, 110 * 16: 150}, {90 * 16: 300}, {171 * 16: 120, 86 * 16: 120}, {2400: 200}])
def test_the_plan_places_documents_at_any_slack(spark, monkeypatch, lengths):
    """However little fits together, most documents take places of the plan, and its sequences are the ones filled."""
    encode = packing.Encoder(packing.tokenizer_path())
    [one] = {len(encode.ids(" ".join(["the"] * n))) // 4 - n for n in (1, 50)}
    texts = [" ".join(["the"] * (n - one)) for n, times in lengths.items() for _ in range(times)]
    made = []
    plan = packing.plan
    monkeypatch.setattr(packing, "plan", lambda *a: made.append((a, plan(*a))) or made[-1][1])
    frame = docs(spark, texts)
    rows = packing.packed(frame).collect()
    padding, tokens = check_packing(frame, rows)
    (histogram, _), last = made[-1]
    placed = sum(histogram.values())
    assert placed >= 0.4 * len(texts) and sum(n for _, n in last) >= placed * sum(lengths) / len(lengths) / packing.CAPACITY * 0.9
    assert padding < 0.02 * tokens + packing.CAPACITY
    whole = {r.doc_id for r in rows if r.start == 0 and r.length == r.doc_tokens}
    assert len(whole) >= placed


def test_encoder_is_the_tokenizer():
    encode = packing.Encoder(packing.tokenizer_path(), limit=50)
    whole = lambda t: np.array([*encode.tokenizer.encode(t, add_special_tokens=False).ids, packing.END], "<u4").tobytes()
    rnd = random.Random(1)
    letters = "aZé  ́̀ÉñıİΣσςß\n\t\x0b\x1c\x1f\x85  　'sdt12٣,.!|<>-_日本ｱ𝒜🙂​ǅªµÅ\xa0 ᠎"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        assert encode.ids(text) == whole(text), text
    latin = "".join(map(chr, range(256)))
    for _ in range(3000):
        text = "".join(rnd.choice(latin if rnd.random() < 0.2 else "aé'sdtlrvem12²½ºª.,!_-  \t") for _ in range(rnd.randint(0, 14)))
        assert encode.ids(text) == whole(text), text
    for text in ("<|endoftext|>", "a<|startoftext|>b <|endoftext|>.", "it's we'll O'S", "<|ENDOFTEXT|>", "", "Word, WORD; word"):
        assert encode.ids(text) == whole(text), text
    assert encode.ids(None) == whole("")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS size", "'y' AS key")


def test_archive_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://www.example.com/a?b=2&a=1#x", big), (2, "http://example.com/a", big), (3, None, big), (4, "http://z.org", other[:999]),
            (5, "http://z.org", other[:999]), (6, "not a url [", None), (7, "http://z.org:8080/\r\n", ""), (8, "http://z.org", other)] + [(9, "http://z.org", other)] * 2
    got = sorted(warc.round_trip(pages(spark, rows)).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows)
    import hashlib

    for r, (i, _, html) in zip(got, rows):
        data = (html or "").encode()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (i, len(data), hashlib.sha1(data).hexdigest())
    assert [(r.record_type, r.refers_to) for r in got] == [
        ("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None), ("response", None), ("response", None),
        ("revisit", 9), ("response", None), ("response", None),
    ]
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_index_finds_every_key_and_no_other(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 50}", "x" * (i % 2000)) for i in range(1500)]
    folder = f"file://{tmp_path}/w"
    manifest = warc.archive(pages(spark, rows).repartition(5), folder)
    shards = warc.index(manifest, folder)
    assert shards.agg(F.sum("n")).first()[0] == 1500
    found = warc.Index([(r.first, r.file) for r in shards.collect()], warc.Files())
    want = {r.key: (r.file, r.offset, r.length) for r in manifest.collect()}
    for k in random.Random(1).sample(sorted(want), 300):
        assert list(found.find(k)) == [want[k]]
    for k in ("", "zzz", "com,example,h3)/1\t0", "com,example,h3)/1"):
        assert list(found.find(k)) == []
    some = spark.createDataFrame([(warc.key(u, i),) for i, u, _ in rows[::100]], "key string")
    got = {r.page_id: bytes(r.payload) for r in warc.look_up(some, shards, payload=True).collect() if r.payload is not None}
    assert all(got[i] == rows[i][2].encode() for i in got) and len(got) >= 10


def test_records_that_are_damaged_are_told():
    member = warc.record(1, "http://a.b", b"payload" * 10, None, False, "2024-01-01T00:00:00Z")
    assert warc.parse(member)["payload"] == b"payload" * 10
    import zlib as z

    bad = z.compressobj(3, z.DEFLATED, 31)
    data = z.decompress(member, 31).replace(b"payload", b"pAyload", 1)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(bad.compress(data) + bad.flush())


def test_surt():
    assert warc.surt("https://www.Example.com:443/a/b?z=1&a=2#f") == "com,example)/a/b?a=2&z=1"
    assert warc.surt(None) == "" and warc.surt("http://h:99/") == "h:99)/"
    assert warc.key("http://a.b/", None) < warc.key("http://a.b/", -5) < warc.key("http://a.b/", 3)


def test_very_long_payloads_come_back(spark):
    text = "<p>ünï 🙂</p>" * 200_000
    rows = [(1, "http://a.b/1", text), (2, "http://a.b/2", text), (3, "http://a.b/3", "x")]
    got = sorted(warc.round_trip(pages(spark, rows)).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.payload_bytes, r.refers_to) for r in got] == [(1, len(text.encode()), 2), (2, len(text.encode()), None), (3, 1, None)]


def test_pipeline_is_its_stages(spark):
    """Each stage against plain Python over what the stage before it kept."""
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"]
    now, kept = source, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), source.schema)
        assert now.columns == source.columns
        kept.append(now.collect())
    good = {r.doc_id for r in quality.judged(source).collect() if r.kept}
    assert {r.doc_id for r in kept[0]} == good
    ordered = sorted(kept[0], key=lambda r: r.doc_id)
    distinct = {tuple(p) for p in simhash.long_prints([r.text.encode() for r in ordered]).tolist()}
    least = brute_groups([r.text for r in ordered], len(distinct))
    assert sorted(r.doc_id for r in kept[1]) == sorted({ordered[i].doc_id for i in least})
    assert {(r.doc_id, r.text) for r in kept[2]} == {(r.doc_id, pii.masked(r.text)) for r in kept[1]}
    size = {r.doc_id: len(r.text.split()) for r in kept[2]}
    words = sum(len(r.text.split()) for r in kept[3])
    assert words == pytest.approx(1.5 * sum(size.values()), rel=1e-3)
    final = corpus_pipeline.run(spark, sf).collect()
    check_packing(now, final)


def stages_of(spark, frame, folder):
    """The stages as run() chains them, each written and read again; the frames between."""
    out, now = [], frame
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, "nowhere")
        if name != "packing":
            assert made.columns == frame.columns
        made.write.parquet(f"{folder}/{name}")
        now = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
        out.append(now)
    return out


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows, very long texts and columns whose names the stages use themselves."""
    rnd = random.Random(31)
    frame = awkward(spark)
    long = " ".join(f"w{rnd.randrange(9000)}" for _ in range(120_000))
    good = [(100 + i, " ".join(f"u{rnd.randrange(9000)}" for _ in range(60)), "en", rnd.choice(["a", "b", None]), 0) for i in range(20)]
    more = [*good, good[0], good[0], (None, good[1][1] + " x", "en", "a", 0), (300, long, "fr", "a", len(long)), (301, f"{long} end", "fr", "b", 0)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    for c in frame.columns[5:]:
        extra = extra.withColumn(c, F.lit("x"))
    kept, once, masked, mixed_, _ = stages_of(spark, frame.unionByName(extra), f"file://{tmp_path}")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id)
    assert ids(kept) == sorted([*range(100, 120), 100, 100, 300, 301])
    assert ids(once) == [*range(100, 120), 300] and once.where("doc_id IS NULL").count() == 0
    assert ids(masked) == ids(once) and set(ids(mixed_)) <= set(ids(once))
    assert once.where("`x.y` = 'x' AND `a``b` = 'x' AND __id = 'x'").count() == 21


def test_empty_and_repeated_tables_go_through_all_stages(spark, tmp_path):
    assert [df.count() for df in stages_of(spark, empty(spark), f"file://{tmp_path}/empty")] == [0] * 5
    text = " ".join(f"word{i}" for i in range(50))
    same = docs(spark, [text]).unionByName(docs(spark, [text])).unionByName(docs(spark, [text]))
    kept, once, masked, mixed_, _ = stages_of(spark, same, f"file://{tmp_path}/same")
    assert (kept.count(), once.count(), masked.count()) == (3, 1, 1)
    assert sum(len(r.text.split()) for r in mixed_.collect()) == 75  # 150 % of its words
