"""The methods themselves: exact round trips, permutations, brute force, held-out accuracy, spreading of hot groups."""

from __future__ import annotations

import re
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import entries, exchange, hashing, html, lengths, mixing, ngrams, pii, quality, simhash, simple8b, substrings, tokens
from palimpsest.llm.shared import new_path, scope, words, written

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 49_407), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(x)
    assert (simple8b.decode(words, len(x)) == x).all() and offsets[-1] == len(words)
    for b in range(len(offsets) - 1):
        own = x[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        assert (simple8b.decode(words[offsets[b] : offsets[b + 1]], len(own)) == own).all()


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=200))
def test_words_encode_as_the_tokenizer_does(text):
    path = entries.public_tokenizers.path("word_bpe_49k.json")
    own = tokens.words_of(path)
    data = text.encode("utf-8", "ignore")
    assert np.frombuffer(own.encode(data), "<u4").tolist() == own.tokenizer.encode(data.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 2, 3, 8, 13, 16])
def test_rolling_hashes(size):
    h = np.random.default_rng(size).integers(0, 1 << 63, 60).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    want = np.array([sum(int(h[i + j]) * pow(base, size - 1 - j, 1 << 64) for j in range(size)) % (1 << 64) for i in range(61 - size)], np.uint64)
    assert (hashing.rolling(h, size) == (want ^ (want >> np.uint64(32))) * hashing.MIX).all()


def test_word_hashes():
    """Equal words, and only they, have equal hashes, wherever they stand."""
    rng = random.Random(2)
    texts = ["", " \t", "a", *(" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(300))) for _ in range(40)), "x " * 700_000]
    hashes, counts = hashing.word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    pairs = set(zip(words, hashes.tolist(), strict=True))
    assert len(pairs) == len(set(words)) == len({h for _, h in pairs})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(2**63, 2**63 + 3), st.integers(0, 2**64 - 1)), max_size=200))
def test_stable_sort(values):
    h = np.array(values, np.uint64)
    order, ordered = hashing.stable_sort(h)
    assert (order == np.argsort(h, kind="stable")).all() and (ordered == np.sort(h)).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=700), st.sets(st.integers(0, 2**64 - 1), max_size=700))
def test_parity_maps_never_differ_in_more_than_their_sets(a, b):
    from palimpsest.llm import similar

    x, y = (np.sort(np.array(sorted(s), np.uint64)) for s in (a, b | set(list(a)[:300])))
    assert similar.differ(similar.parity_map(x), similar.parity_map(y)) <= len(np.setxor1d(x, y))


def brute_simhash(text: str) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", "one", "one two", "a b c d e a b c", "Ä Ö ü " * 40):
        assert simhash.simhash(text.encode()) == brute_simhash(text)


def classes(fps: list[int]) -> dict[int, int]:
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


def test_links_and_components(spark):
    """Chains, pairs, and a dense ball that many fingerprints share table entries in, against all pairs."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [fps[0] ^ 1 << i for i in range(40)] + [fps[0] ^ 1 << i ^ 1 << j for i in range(0, 30, 3) for j in range(i + 1, 40, 4)]
    x = fps[1]
    for i in range(12):
        x ^= 1 << (2 * i) | 1 << (2 * i + 1)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = simhash.links(df)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges.collect())
    got = {r["node"] & (1 << 64) - 1: r["label"] & (1 << 64) - 1 for r in simhash.components(edges).collect()}
    want = classes(fps)
    groups = lambda m: sorted(sorted(k for k in fps if m.get(k, k) == v) for v in set(m.get(k, k) for k in fps))
    assert groups(got) == groups(want)


def test_near_duplicates_with_a_hot_group(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(i, base if i % 3 == 0 else base + f" tail{i % 7}" if i % 3 == 1 else f"text number {i} " * 9) for i in range(300)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: brute_simhash(t) for i, t in rows}
    want = classes(sorted(set(fps.values())))
    least: dict = {}
    for i, f in fps.items():
        least[want[f]] = min(i, least.get(want[f], i))
    assert found == {i: least[want[f]] for i, f in fps.items()}


def near_classes(texts: list[str]) -> set[int]:
    """The least index of each class of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    def own(text):
        w = text.lower().split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets, label = [own(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return set(label)


def test_pipeline_near_dedup_against_brute_force(spark, monkeypatch):
    """Edited copies, chains of edits, a common passage and a dense group, against all pairs."""
    import corpus_pipeline
    from palimpsest.llm import similar

    monkeypatch.setattr(similar, "COMMON", 5)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=25)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randrange(4, 150))
        for _ in range(rng.randrange(1, 9)):
            texts.append(base)
            base = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
    dense = rng.choices(words, k=120)
    texts += [[rng.choice(words) if rng.random() < 0.015 else w for w in dense] for _ in range(40)]
    texts += [passage + rng.choices(words, k=rng.randrange(4, 12)) for _ in range(40)]
    texts += [[], ["one"], ["One"], ["one", "two"]]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = near_classes(texts)
    assert 20 < len(want) < 120
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


def test_pipeline_near_dedup_links_by_simhash_first(spark, monkeypatch):
    """Texts one word apart link through the fingerprints' pivot tables, and pairs of a group are joined by one of its shingles."""
    from palimpsest.llm import similar

    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(400)], k=900)
    far = [rng.choice(base) if i % 40 == 7 else w for i, w in enumerate(base)]
    texts = [base, [*base[:450], "other", *base[451:]], far, rng.choices(base, k=80)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    own = similar.sketched(simhash.packed(docs), 5, np.zeros(0, np.uint64)).toPandas().set_index("doc_id")
    assert [int(f) & (1 << 64) - 1 for f in own["fp"]] == [simhash.majority([similar.shingles(" ".join(t).encode())]) for t in texts]
    sets, asked, real = spark.createDataFrame(own.reset_index()[["sid", "fp"]]), [], similar.decided

    def decided(pairs, *rest):
        asked.append((rest[-1], {frozenset((r["a"], r["b"])) for r in pairs.collect()}))
        return real(pairs, *rest)

    monkeypatch.setattr(similar, "decided", decided)
    near = {frozenset((r["a"], r["b"])) for r in similar.by_simhash(sets).collect()}
    assert near == {frozenset((own["sid"][0], own["sid"][1]))}
    assert {r["doc_id"] for r in similar.one_of_each(docs).collect()} == {0, 2, 3}
    assert asked[0] == ("near-simhash", near)
    one = lambda bits: F.array(*[F.lit(x).cast("long") for x in bits])
    told = spark.range(1).select(*[similar.close_maps(a, b, F.lit(n)).alias(k) for k, a, b, n in (("same", one([1, 2, 3, 4]), one([1, 2, 3, 4]), 0), ("half", one([1, 2, 3, 4]), one([2, 6]), 0), ("apart", one([7, 0]), one([0, 0]), 26), ("near", one([7, 0]), one([0, 0]), 27))])
    assert tuple(told.first()) == (True, True, False, True)


def near_copies() -> list[str]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=90)
    return sorted({" ".join(rng.choice(words) if rng.random() < 0.02 else w for w in base) for _ in range(60)})


def test_pipeline_near_dedup_meets_a_pair_once(spark, monkeypatch):
    """Of near copies that share many shingles, the join of pairs makes a row for each similar pair, and hardly another."""
    from palimpsest.llm import similar

    texts = near_copies()
    own = similar.sketched(simhash.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), 5, np.zeros(0, np.uint64)).localCheckpoint()
    members = own.select("sid", "n", F.col("sid").alias("label"), "p0", "p1", "p2", "p3", F.lit(60).alias("members"), F.explode("prefix").alias("key"))
    sids = {r["doc_id"]: r["sid"] for r in own.select("doc_id", "sid").collect()}
    sets = [similar.shingles(t.encode()) for t in texts]
    near = {tuple(sorted((sids[i], sids[j]))) for i in range(len(texts)) for j in range(i) if similar.similar(sets[i], sets[j])}

    def made(which):
        rows = similar.marked(members, own.select("sid", "wide"))
        return [tuple(r) for r in similar.close_pairs(rows, rows, which).collect()]

    once = made(F.col("a_sid") < F.col("b_sid"))
    assert len(once) == len(set(once)) and near <= set(once) and len(once) < 1.3 * len(near)
    monkeypatch.setattr(similar, "FIRST", 1)
    assert set(made(F.col("a_sid") < F.col("b_sid"))) == set(once)


def test_pipeline_near_dedup_of_a_crowd(spark, monkeypatch):
    """Further leaders change no class."""
    from palimpsest.llm import similar

    for name, value in (("COMMON", 5), ("CROWD", 15), ("FIRST", 2)):
        monkeypatch.setattr(similar, name, value)
    texts, drawn, real = near_copies(), [], similar.with_crowd
    monkeypatch.setattr(similar, "with_crowd", lambda members: drawn.append(members.count()) or real(members))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in similar.one_of_each(docs).collect()} == near_classes(texts)
    assert drawn[0] > 0


def test_feistel_is_a_permutation(spark):
    a, b = (F.lit(x).cast("long") for x in (189, 773))
    out = spark.range(189 * 773).select(pii.feistel(F.col("id"), a, b, "k", "d").alias("v"))
    assert tuple(out.agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()) == (189 * 773, 0, 189 * 773 - 1)


def one(spark, text: str, key: str = "k") -> str:
    return pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first()["text"]


def test_pseudonyms_keep_format_and_links(spark):
    text = "4111 1111 1111 1111 and 4111-1111-1111-1111, 2024-02-29 or 29/02/2024, 10.1.2.3, DE89370400440532013000, 123-45-6789."
    new = one(spark, text)
    assert new != text and len(new) == len(text) - len("10.1.2.3") + len(new.split(", ")[2])
    spaced, dashed = new[:19], new[24:43]
    assert spaced.replace(" ", "") == dashed.replace("-", "") and spaced[0] == "4"
    digits = [int(c) for c in spaced.replace(" ", "")]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    iso, local = new.split(", ")[1].split(" or ")
    assert iso == "-".join(reversed(local.split("/")))
    iban = new.split(", ")[3]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert one(spark, text) == new and one(spark, text, "other") != new


def test_invalid_values_stay(spark):
    text = "4111 1111 1111 1112, 2023-02-29, 300.1.1.1, DE89370400440532013001, 000-12-3456"
    assert one(spark, text) == text


def test_targets_share_out_the_budget(spark):
    sizes = spark.createDataFrame([("a" + k, n) for k, n in zip("abcdefg", (100, 1, 1000, 50, 0, 700, 30), strict=True)], "key string, source_size long")
    rows = {r["key"]: r for r in mixing.targets(sizes, mixing.SCHEDULES, 1.5, 2).collect()}
    left, weight = 1.5 * 1881, {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(rows))}
    target, open_ = {}, dict(weight)
    while open_:
        level = left / sum(open_.values())
        stop = [k for k, w in open_.items() if level * w > 2 * rows[k]["source_size"]]
        if not stop:
            target |= {k: level * w for k, w in open_.items()}
            break
        for k in stop:
            target[k] = 2.0 * rows[k]["source_size"]
            left -= target[k]
            del open_[k]
    assert {k: pytest.approx(target[k]) for k in rows} == {k: r["target"] for k, r in rows.items()}


def test_positions_follow_the_schedule(spark):
    """The share of a source's tokens before a time is its schedule's integral up to it."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("source"))
    at = mixing.mix(docs).select("source", F.explode("positions").alias("t")).toPandas()
    for name, schedule in zip("xyz", mixing.SCHEDULES, strict=True):
        t = np.sort(at.t[at.source == name])
        for cut in (0.2, 0.5, 0.8):
            xs = np.linspace(0, cut, 2001)
            want = np.trapezoid(np.interp(xs, *zip(*schedule, strict=True)), xs) / mixing.area(schedule)
            assert abs((t <= cut).mean() - want) < 0.01
    order = mixing.curriculum(docs).count()
    assert order == len(at)


def test_quality_verdicts_on_held_out_labels(spark):
    """Profiles come from the corpus without labels; the labels only judge the verdicts."""
    d = "/root/testdata/sf0.01"
    found = quality.quality(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "kept", "base_failed")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def brute_repeats(words: list[str]) -> int:
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=8))
def test_repeated_words(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i long, text string")
    counts = quality.base_counts(words(F.col("text")), F.col("text"))
    got = {r["i"]: r["n_repeat_words"] for r in rows.select("i", counts["n_repeat_words"].alias("n_repeat_words")).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_js_distance(spark):
    p, q = (F.array(*[F.lit(x) for x in v]) for v in ((0.5, 0.5, 0.0), (0.0, 0.0, 1.0)))
    assert tuple(spark.range(1).select(quality.js_distance(p, q), quality.js_distance(p, p)).first()) == (1.0, 0.0)


def test_main_text():
    body = "<p>" + "The plan of the day was that all of us would go to the sea and stay there for as long as it was warm. " * 2 + "</p>"
    page = f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><h1>News</h1>{body}<p>Short of it.</p>{body}<div class='comments'><p>{'I think that it is what it is and so on. ' * 5}</p></div><footer>&copy; us</footer></body></html>"
    text = html.main_text(page).split("\n")
    assert text[0] == "News" and text[2] == "Short of it." and len(text) == 4
    assert html.main_text("<article><h1>A&amp;B</h1><p>x<br>y <b>z</b></p><aside>no</aside></article><p>no</p>") == "A&B\nx y z"
    assert html.main_text("<p>a</p>" * 3) == "a\na\na" and html.main_text("<p>a &lt; b") == "a < b"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "mixing_sources":
            assert docs.count() <= before
            before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("stored", [True, False])
def test_pipeline_writes_tokens_in_training_order(spark, stored):
    import corpus_pipeline
    from palimpsest.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    taken = mixing.mix(docs).select("doc_id", F.explode("positions").alias("p")).collect()
    want = [r["doc_id"] for r in sorted(taken, key=lambda r: (r["p"], r["doc_id"]))]
    assert want != sorted(want)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    # more files than tasks, of unlike sizes, are read out of order
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "17")
    try:
        mixed = written(mixed, "mixed") if stored else spark.createDataFrame(mixed.collect(), mixed.schema)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = corpus_pipeline.token_output(spark, mixed, SF).collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] == want


def test_pipeline_with_empty_documents(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_packed_hashes_round_trip(hashes):
    h = np.sort(np.array(sorted(hashes), np.uint64))
    assert (exchange.unpack_sorted(exchange.pack_sorted(h)) == h).all()


def brute_scores(texts: dict[int, str]) -> dict[int, float]:
    from collections import Counter
    from math import log

    words = {k: t.split() for k, t in texts.items()}
    own = {k: [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in (1, 2, 3)] for k, w in words.items()}
    every = [sum((o[n] for o in own.values()), Counter()) for n in range(3)]
    total, out = sum(map(len, words.values())), {}
    for k, w in words.items():
        rest = [every[n] - own[k][n] for n in range(3)]
        out[k] = 0.0
        for i in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[max(0, i - n + 1) : i + 1])
                if len(g) == n and rest[n - 1][g]:
                    context = rest[n - 2][g[:-1]] if n > 1 else total - len(w)
                    out[k] += log(rest[n - 1][g] / context) + (3 - n) * log(0.4)
                    break
            else:
                out[k] += log(0.4 / max(total - len(w), 1)) + 2 * log(0.4)
    return out


def test_scores_against_brute_force(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice("the a cat dog sat on mat ran".split()) for _ in range(rng.randrange(0, 40))) for i in range(40)}
    got = {r["doc_id"]: r["log_score"] for r in ngrams.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: pytest.approx(v) for k, v in brute_scores(texts).items()}


def test_scores_against_joined_tables(spark):
    """The packed exchange gives what count tables joined to exploded n-grams give."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    got = {r["doc_id"]: r for r in ngrams.scores(docs).collect()}
    want = {r["doc_id"]: r for r in ngrams.joined_scores(docs).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k]["n_words"], got[k]["n_seen"]) == (r["n_words"], r["n_seen"])
        assert got[k]["log_score"] == pytest.approx(r["log_score"]) and got[k]["mean_log_score"] == (r["mean_log_score"] and pytest.approx(r["mean_log_score"]))


def test_rows_without_doc_id_are_dealt_to_many_chunks(spark, monkeypatch):
    """1,000 rows without doc_id spread over chunks by their texts; rows alike travel together and all come back."""
    texts = [f"row {i} says one two three four five six seven eight nine ten eleven twelve" for i in range(500)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, "all of these are the same row")] * 500 + [(1, texts[0])], "doc_id long, text string")
    monkeypatch.setattr(ngrams, "CHUNK_CHARS", 4000)
    dealt, _ = exchange.deal(docs, sum(map(len, texts)), 4000)
    per_chunk = {r["chunk"]: r["n"] for r in dealt.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert len(per_chunk) > 8
    rows = ngrams.scores(docs).collect()
    assert len(rows) == 1001 and {r["n_seen"] for r in rows if r["n_words"] == 7} == {5}
    found = substrings.repeated(docs).collect()
    assert len(found) == 1001 and [r["n_removed"] for r in found if r["doc_id"] == 1] == [15]
    assert {r["n_removed"] for r in found if r["doc_id"] is None} == {0}


def test_histogram_against_brute_force(spark):
    rng = random.Random(6)
    counts = [(rng.choice("ab"), int(rng.expovariate(1 / 3000))) for _ in range(500)]
    hist = lengths.histogram(spark.createDataFrame(counts, "lang string, n_tokens long"), ["lang"])
    for r in hist.collect():
        own = [n for k, n in counts if k == r["lang"]]
        longer = [n for n in own if n >= r["n_tokens"]]
        assert (r["docs_from"], r["tokens_from"], r["docs_total"], r["tokens_total"]) == (len(longer), sum(longer), len(own), sum(own))
        assert r["tokens_cut"] == sum(min(n, r["n_tokens"]) for n in own)
    for r in lengths.at_limits(hist, ["lang"], [100, 3000, 10**6]).collect():
        own = [n for k, n in counts if k == r["lang"]]
        assert (r["docs_over"], r["tokens_cut"]) == (sum(n > r["context_limit"] for n in own), sum(min(n, r["context_limit"]) for n in own))


def test_tokens_against_the_tokenizer(spark):
    """op4's rows, read back from its files, against the library on whole texts."""
    import zlib

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in entries.op4_token_output(spark, SF).collect()}
    tokenizer = tokens.Tokenizer.from_file(entries.public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in rows:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        found = got[r["doc_id"]]
        assert (found["start"], found["n_tokens"], found["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_queries_match_their_sql(spark):
    from tests import compare

    for name, sql in entries.oracle_sql().items():
        assert compare.differences(entries.queries()[name](spark, SF), sql, SF) == "", name


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in entries.queries()) == list(range(1, 11))


def test_scopes_remove_their_tables(spark):
    import os

    with scope(spark):
        inner = new_path(spark, "inner").removeprefix("file://")
        written(spark.range(3), "gone")
        os.makedirs(inner)
        with scope(spark):
            outer = written(spark.range(5), "lasting", lasting=True)
        kept = written(outer, "kept", lasting=True)
        assert outer.count() == 5
    assert not os.path.exists(inner) and kept.count() == 5 and not os.path.exists(outer.inputFiles()[0].removeprefix("file://"))


def test_main_text_of_awkward_pages():
    """Names that err, headers of articles, other languages, reader comments: pages labelled by hand."""
    said = "It is what it is, and that is all that there is to say of it in the end. "
    shared = f"<nav><a href=x>Home</a></nav><div class='share-story'><h1>Title</h1><p>{said * 4}</p></div><footer>Us</footer>"
    assert html.main_text(shared) == f"Title\n{(said * 4).strip()}"
    headed = f"<div class='page-header'><h1>Title</h1></div><div class='content'><p>{said * 4}</p></div><div class='site-header'><p>{said * 3}</p></div>"
    assert html.main_text(headed) == f"Title\n{(said * 4).strip()}"
    talk = f"<h1>Title</h1><p>{said * 4}</p><div class='discussion'><p>{said * 4}</p></div><div class='user-comments'><p>{said * 9}</p></div>"
    assert html.main_text(talk) == f"Title\n{(said * 4).strip()}"
    only_talk = f"<h1>Title</h1><div class='reader-comments'><p>{said * 4}</p></div>"
    assert html.main_text(only_talk) == "Title"
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, aby świętować otwarcie nowego mostu przez rzekę, którego budowa trwała cztery lata."
    page = f"<ul><li>Start</li><li>Oferta</li></ul><h1>Nowy most</h1><p>{polish}</p><p>Krótkie zdanie.</p><p>{polish}</p><div>Kontakt tel. 12</div><p>Prawa zastrzeżone</p>"
    assert html.main_text(page) == f"Nowy most\n{polish}\nKrótkie zdanie.\n{polish}"
    chinese = "昨天晚上，市民们聚集在市政厅前，庆祝横跨河流的新大桥正式通车，这座大桥的建设历时四年，耗资数亿，期间克服了许多技术上的困难与挑战。"
    assert html.main_text(f"<div>首页</div><h1>新大桥</h1><p>{chinese}</p><p>{chinese}</p><div>版权所有</div>") == f"新大桥\n{chinese}\n{chinese}"
    linked = "It was <a href=x>the work of many hands over many long years</a> and <a href=y>of those who came to see it all</a>, as it is said of it today in <a href=z>the old town by the sea</a>."
    page = f"<article><h1>Title</h1><p>{said * 4}</p><p>{linked}</p><ul><li><a href=1>More of this and that</a></li></ul></article>"
    assert html.main_text(page).split("\n")[1:] == [(said * 4).strip(), re.sub("<[^>]*>", "", linked)]


def test_dates_keep_apart(spark):
    """Every day of a block of 400 years, day first, month first and unpadded: no two days share a pseudonym, each reads as its own reads."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(146_097).select(day.alias("day"))
    rows = days.select("day", F.explode(F.array(F.date_format("day", "dd/MM/yyyy"), F.date_format("day", "MM/dd/yyyy"), F.date_format("day", "M/d/yyyy"))).alias("text"))
    # what reads day first is the day that it reads so
    first = F.coalesce(F.try_to_timestamp("text", F.lit("d/M/yyyy")), F.try_to_timestamp("text", F.lit("M/d/yyyy"))).cast("date")
    told = rows.select(first.alias("day"), "text").distinct().withColumn("new", pii.new_date_text(F.col("text"), "k"))
    reads = lambda c, f: F.try_to_timestamp(c, F.lit(f)).isNotNull()
    same_way = (reads("text", "d/M/yyyy") == reads("new", "d/M/yyyy")) & (reads("new", "d/M/yyyy") | reads("new", "M/d/yyyy"))
    row = told.agg(F.count_if(F.col("new").isNull() | ~same_way).alias("bad"), F.count_if(F.length("new") > 10).alias("long"), F.count_if(F.col("new") == F.col("text")).alias("still")).first()
    assert (row["bad"], row["long"]) == (0, 0) and row["still"] < 1_000
    assert told.groupBy("new").agg(F.count_distinct("day").alias("n")).filter("n > 1").count() == 0
    months = told.filter(~reads("text", "d/M/yyyy") & F.col("text").rlike("^[0-9]{2}/"))
    assert months.select("new").distinct().count() == months.count() == days.filter(F.dayofmonth("day") > 12).count()


def test_batches_of_bounds_what_python_gets(spark):
    import pyarrow as pa

    from palimpsest.llm.shared import batches_of

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    most = lambda: spark.range(0, 900, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    with batches_of(spark, 100):
        assert most() == 100
        with batches_of(spark, 500):  # the lesser holds
            assert most() == 100
    assert most() == 900
