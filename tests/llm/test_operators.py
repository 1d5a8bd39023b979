"""The corpus operators against brute force on whole small tables and on odd rows."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import oracle
from treeline.llm import ann, bpe, components, exact_dedup, language_id, mixing, ngram_jaccard, oracles, pii, quality, queries, sharding, url_filters


def run(spark, sf, name):
    return queries.queries()[name](spark, sf).toPandas()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, sf, name):
    oracle.assert_same(queries.queries()[name](spark, sf), oracles.oracle_sql()[name], oracle.connect(sf))


# 1 sharding


def check_shards(got, n, shards):
    counts = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(got) == n and counts.max() - counts.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)


def test_sharding(spark, sf, texts):
    got = run(spark, sf, "op1_sharding").sort_values("doc_id").reset_index(drop=True)
    check_shards(got, len(texts), 24)
    assert (got["size"] == [len(t.encode()) + 8 for t in texts.text]).all() and (got.text_crc32 == [zlib.crc32(t.encode()) for t in texts.text]).all()
    groups = got.assign(t=texts.text).groupby("t").shard.agg(["nunique", "size"])
    assert (groups[groups["size"] > 1]["nunique"] == 1).mean() > 0.9


def test_sharding_splits_a_huge_group(spark):
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_rows(docs).toPandas()
    check_shards(got, 1200, 24)
    assert got[got.doc_id < 600].shard.nunique() < 20  # 12 at best; 24 if dealt at random


def test_sharding_odd(odd_docs, no_docs):
    got = sharding.shard_rows(odd_docs, 4).toPandas()
    check_shards(got, odd_docs.count(), 4)
    assert got[got.doc_id == 4]["size"].item() == 8 and got[got.doc_id == 4].text_crc32.item() == 0
    assert sharding.shard_rows(no_docs).count() == 0


# 2 mixing


def test_schedule_deviates_less_than_a_block():
    slots, period = mixing.quantised({"a": 0.5, "b": 0.31, "c": 0.19, "d": 0.001}, 200)
    assert sum(slots.values()) == period
    have = Counter()
    for s, i, t in mixing.schedule(slots, period):
        assert i * period // slots[s] <= t < -(-(i + 1) * period // slots[s])
        have[s] += 1
        assert all(abs(have[x] - slots[x] * (t + 1) / period) < 1 for x in slots)


@pytest.mark.parametrize("n", [20, 100, 300])
def test_schedule_follows_targets(n):
    """A source with a third of the weight beside many: within a block of the targets, not of rounded weights."""
    weights = {"hot": n / 2, **{f"s{i}": 1 + i % 3 / 1e6 for i in range(n)}}
    total = sum(weights.values())
    slots, period = mixing.quantised(weights)
    assert abs(slots["hot"] - weights["hot"] / total * period) < 1 and sum(slots.values()) == period and min(slots.values()) > 0
    exact, whole = mixing.exact_weights(weights)
    have = Counter()
    for s, _, t in mixing.schedule(exact, whole, {s: 5_000 if s == "hot" else 100 for s in weights}):
        have[s] += 1
        if t < 10_000:
            assert abs(have["hot"] - weights["hot"] / total * (t + 1)) < 1
    assert have["hot"] == 5_000 and sum(have.values()) == 5_000 + 100 * n


def test_mix_follows_targets_over_the_run(spark):
    """Over 4,000 blocks a rounded weight of 1/3 would be a block off; small sources run dry long before."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"))
    got = mixing.mix(docs, {"hot": 10.0, **{f"s{i}": 1.0 for i in range(20)}}, block_rows=1).toPandas()
    hot = got[got.source == "hot"].sort_values("slot")
    assert len(got) == 12_000 and got.slot.is_unique and ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    assert (np.abs(np.arange(1, 6_001) - (hot.slot.to_numpy() + 1) / 3) < 1).all() and np.allclose(hot.weight, 1 / 3)


def test_mix_by_shuffle(odd_docs, monkeypatch):
    want = Counter(map(repr, mixing.mix(odd_docs, block_rows=2).select(*mixing.MADE).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert Counter(map(repr, mixing.mix(odd_docs, block_rows=2).select(*mixing.MADE).collect())) == want


def test_mixing(spark, sf, texts):
    got = run(spark, sf, "op2_mixing")
    assert sorted(got.doc_id) == sorted(texts.doc_id) and not got.duplicated(["slot", "place"]).any()
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all() and got.groupby("slot").source.nunique().max() == 1
    for s, g in got.groupby("source"):
        assert sorted(g.block * mixing.BLOCK_ROWS + g.place) == list(range(len(g)))


def test_mixing_odd(odd_docs, no_docs):
    got = mixing.mix(odd_docs, {"a": 3.0, None: 1.0}, block_rows=2).toPandas()
    assert len(got) == odd_docs.count() and not got.duplicated(["slot", "place"]).any()
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_order(odd_docs).columns == odd_docs.columns
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, {"a": 0.0})


# 3 URL filters


def test_url_filters_odd(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org"), (3, None), (4, "nothing"), (5, "x://ads-track.foo.net/a"), (6, "http://notexample.org/en/12"), (6, "http://notexample.org/en/12"),
            (7, "http://example.org/en/12#t"), (8, "http://b.com/de/"), (9, "http://b.net/x/ads/y"), (None, "http://com/fr/"), (10, "http://É.com/fr/\n")]
    pages = spark.createDataFrame([(i, u, "h", "t", 0) for i, u in rows], "page_id long, url string, host string, token string, rank int")
    got = {(r["page_id"], r["rule"], r["verdict"], r["host"]) for r in url_filters.judge(pages).collect()}
    assert got == {(1, "example.org/es/", "block", "a.example.org"), (2, None, "allow", "example.org"), (3, None, "allow", ""), (4, None, "allow", ""), (5, None, "block", "ads-track.foo.net"),
                   (6, "org/", "allow", "notexample.org"), (7, "example.org/en/1", "block", "example.org"), (8, "com/de/", "block", "b.com"), (9, None, "block", "b.net"), (None, "com/fr/", "allow", "com"), (10, "com/fr/", "allow", "É.com")}
    assert url_filters.judge(pages).count() == len(rows) and url_filters.judge(pages.where("false")).count() == 0


def test_url_rules_without_tokens_and_with_one_name(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x.exe"), (2, "http://b.net/zip"), (3, "http://c.net/q"), (3, "http://c.net/q"), (4, None)], "page_id long, url string")
    rules = [{"rule": "no token", "verdict": "block", "pattern": r"\.exe$", "tokens": [], "rank": 0}, url_filters.rule("/zip^", name="one"), url_filters.rule("/q^", name="one"), url_filters.rule("||c.net/", "allow", "firm", 3)]
    got = sorted((r["page_id"], r["rule"], r["verdict"], r["pattern_rule"]) for r in url_filters.judge(pages, rules).collect())
    assert got == [(1, None, "block", "no token"), (2, None, "block", "one"), (3, "firm", "allow", None), (3, "firm", "allow", None), (4, None, "allow", None)]
    with pytest.raises(ValueError):
        url_filters.judge(pages, [{"rule": "bad", "verdict": "block", "pattern": "(", "tokens": [], "rank": 0}])


def test_url_rules_equal_trying_each_on_all(spark, sf):
    """Every rule's expression on every page, without an index; tokens that rules need are held by all URLs they fit."""
    rules = [*url_filters.default_rules(), *(url_filters.rule(p) for p in ("||a*", "/e", "s/^", "||*.org/e*n/", "-", "*"))]
    want = Counter()
    for r in run(spark, sf, "op3_url_filters")[["page_id", "host", "path"]].itertuples():
        fit = [x for x in rules if re.search(x["pattern"], r.host + r.path)]
        firm, loose = (sorted((x for x in fit if (x["rank"] > 0) == f), key=lambda x: (-x["rank"], x["verdict"] != "block" if not f else 0, x["rule"])) for f in (True, False))
        want[r.page_id, firm[0]["rule"] if firm else None, (firm or loose or [{"verdict": "allow"}])[0]["verdict"], None if firm or not loose else loose[0]["rule"]] += 1
    got = url_filters.judge(spark.read.parquet(f"{sf}/pages.parquet"), rules).collect()
    assert Counter((r["page_id"], r["rule"], r["verdict"], r["pattern_rule"]) for r in got) == want
    assert url_filters.literal_tokens("||ads-track.") == ["ads-track"] and url_filters.literal_tokens("/e") == [] and url_filters.literal_tokens("||a.b/c*") == ["a", "b"]


def test_url_rules_by_shuffle(spark, sf, monkeypatch):
    want = run(spark, sf, "op3_url_filters")
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    assert oracle.rows(run(spark, sf, "op3_url_filters")) == oracle.rows(want)


# 4 language identification


def test_suffix_automaton_holds_all_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    moves = language_id.suffix_automaton(text)

    def holds(xs):
        s = 0
        for x in xs:
            if x not in moves[s]:
                return False
            s = moves[s][x]
        return True

    subs = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    import itertools

    assert all(holds(x) == (x in subs) for k in range(1, 5) for x in itertools.product((1, 2, 3), repeat=k))


def naive_phrases(rest, own):
    n = 0
    while rest:
        k = max([j for j in range(1, min(len(rest), len(own)) + 1) if rest[:j] in own], default=1)
        n, rest = n + 1, rest[k:]
    return n


def test_phrases_equal_a_naive_parse():
    """Whole texts, across the ends of blocks, with letters of several scripts."""
    samples = {"x": ["abab acab"], "y": ["bbbb cccc", "dé"], "z": ["日本語 本日"]}
    p = language_id.Parser(samples)
    rnd = np.random.default_rng(3)
    texts = ["abacabx", "cbcbcb", "zz", "", "abab " * 700, "日本 " * 900] + ["".join(rnd.choice(list("abc 日本é"), n)) for n in (50, 1500, 4000)]
    coded = [language_id.symbols(t) for t in texts]
    for i, own in enumerate(samples.values()):
        train = language_id.symbols("\n".join([*own, ""]))
        assert p.phrases(coded)[:, i].tolist() == [naive_phrases(c, train) for c in coded]


def test_every_language_is_learned_and_ties_are_settled(spark):
    letters = [chr(0x4E00 + i) for i in range(80)]
    rows = [(i * 10 + k, f"{c} {c}{c} {c}", f"lang{i:02d}", "") for i, c in enumerate(letters) for k in range(2)]
    rows += [(2000 + i, "same words", "q" if i < 300 else "p", "") for i in range(550)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, draw string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, docs).collect()}
    assert all(got[i * 10] == f"lang{i:02d}" for i in range(80)) and got[2300] == "q"  # equal samples, more labelled rows
    alike = docs.where("doc_id in (2000, 2300)")
    assert {r["lang_pred"] for r in language_id.identify(alike, alike).collect()} == {"p"}  # the smaller name


def test_long_texts_alone_are_learned(spark):
    docs = spark.createDataFrame([(1, "un deux trois " * 2000, "fr"), (2, "one two three " * 2000, "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, docs).collect()} == {1: "fr", 2: "en"}


def test_language_id(spark, sf, texts):
    got = run(spark, sf, "op4_language_id").merge(texts, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()


def test_language_id_odd(odd_docs, no_docs):
    got = language_id.identify(odd_docs, odd_docs).toPandas()
    assert len(got) == odd_docs.count() and set(got[got.doc_id.isin([4, 5, 6, 12, 13])].lang_pred) == {"und"}
    assert set(language_id.identify(odd_docs, no_docs).toPandas().lang_pred) == {"und"} and language_id.identify(no_docs, odd_docs).count() == 0


# 5 quality


def test_quality(spark, sf, texts):
    got = run(spark, sf, "op5_quality").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()
    assert (got.predicted == got.quality)[got.held_out].mean() > 0.85


def test_trees_fit_and_walk_alike():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = quality.grow(x, y)
    p = t.score(x)
    assert ((p > 0.5) == y).mean() > 0.95
    one = t.base
    for f, c, v in zip(t.feature, t.threshold, t.value):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(x[0, f[node]] > c[node])
        one += v[node - len(f)]
    assert p[0] == pytest.approx(1 / (1 + np.exp(-one)))


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    trees = quality.learn(odd_docs, labels)
    got = quality.score(odd_docs, trees).toPandas()
    assert len(got) == odd_docs.count() and got.score.between(0, 1).all()
    assert set(quality.score(odd_docs, quality.learn(odd_docs, labels.where("false"))).toPandas().score) == {0.5}
    assert quality.keep_good(odd_docs, trees, 0.0).columns == odd_docs.columns and quality.keep_good(no_docs, trees).count() == 0


# 6 exact dedup


def naive_dedup(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]", "", t or ""), len(t or "")) for i, t in rows]
    best, size = {}, Counter(n for _, n, _ in norm)
    for i, n, k in norm:
        rank = (-k, i is not None, i or 0)
        best[n] = min(best.get(n, (rank, i)), (rank, i), key=lambda x: x[0])
    return Counter((i, best[n][1], size[n], best[n][1] == i, hashlib.sha256(n.encode()).hexdigest()) for i, n, _ in norm)


@pytest.mark.parametrize("mark", [exact_dedup.fingerprint, lambda c: F.pmod(F.xxhash64(c), F.lit(7))])
def test_exact_dedup_odd(odd_docs, no_docs, mark):
    got = exact_dedup.dedup(odd_docs, mark=mark)
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == naive_dedup([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert exact_dedup.dedup(no_docs).count() == 0


def test_keep_first_keeps_null_ids(spark, odd_docs):
    want = Counter((i, n) for (i, _, _, kept, n), k in naive_dedup([(r["doc_id"], r["text"]) for r in odd_docs.collect()]).items() if kept for _ in range(k))
    sha = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    assert Counter(map(tuple, exact_dedup.keep_first(odd_docs).select("doc_id", sha).collect())) == want and (None in {i for i, _ in want})
    same = spark.createDataFrame([(1, "a b"), (None, "a b"), (2, "a\tb"), (None, "unlike"), (3, "un  like"), (4, "c")], "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.keep_first(same).collect())) == Counter([(None, "a b"), (3, "un  like"), (4, "c")])


def test_colliding_fingerprints_are_told_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weak = exact_dedup.dedup(docs, mark=lambda c: F.pmod(F.xxhash64(c), F.lit(50)))
    assert oracle.rows(weak.toPandas()) == oracle.rows(exact_dedup.dedup(docs).toPandas())


# 7 BPE


@pytest.fixture(scope="module")
def tiktoken_own():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def digests(enc, t):
    ids = enc.encode_ordinary(t)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()


def test_bpe(spark, sf, texts, odd_docs, no_docs, tiktoken_own):
    got = run(spark, sf, "op7_bpe").sort_values("doc_id")
    assert [tuple(r) for r in got[["n_tokens", "ids_sha256", "decoded_sha256"]].to_numpy()] == [digests(tiktoken_own, t) for t in texts.text]
    odd = bpe.encode_decode(odd_docs, *queries.tokenizer(), with_ids=True)
    assert Counter(r[1:4] for r in odd.collect()) == Counter(digests(tiktoken_own, r["text"] or "") for r in odd_docs.collect())
    assert bpe.encode_decode(no_docs, *queries.tokenizer()).count() == 0


def test_late_letters_are_those_that_tiktoken_does_not_know():
    """Each letter or digit of this Unicode version: known if it continues a piece that starts with one."""
    import regex

    tiktoken, pattern = pytest.importorskip("tiktoken"), queries.tokenizer()[1]
    late = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"))
    head = {c: "0" if regex.match(r"\p{N}", c) else "a" for c in late}
    ranks = {bytes([i]): i for i in range(256)} | {(h + c).encode(): 256 + i for i, (c, h) in enumerate(head.items())}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert {c for c, h in head.items() if len(probe.encode_ordinary(h + c)) > 1} == set(regex.findall(f"[{bpe.late_class()}]", "".join(late)))


def test_bpe_on_hard_texts(tiktoken_own):
    path, pattern = queries.tokenizer()
    coder = bpe.MergeReplay(bpe.read_ranks(path), pattern, bpe.late_class())
    hard = ["a" * 5000, "abababab" * 50, " " * 300, "\n\n  \n x", "É" * 99, "0" * 1234, "", "don't we'll", "\U000323e7a \U00010ee7"]
    for t, ids in zip(hard, coder.encode(hard)):
        assert ids.tolist() == tiktoken_own.encode_ordinary(t) and coder.decode(ids) == t.encode()


# 8 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if passes(k, m[0])]


def check_pii(rows, docs):
    want = Counter(hashlib.sha256(",".join(base(t or "")).encode()).hexdigest() for t in docs)
    assert Counter(r["base_sha256"] for r in rows) == want
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows) == sum(len(base(t or "")) for t in docs)


def test_pii(spark, sf, texts, odd_docs, no_docs):
    check_pii(queries.op8_pii(spark, sf).collect(), texts.text)
    check_pii(pii.find(odd_docs).collect(), [r["text"] for r in odd_docs.collect()])
    assert pii.find(no_docs).count() == 0


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"hello number {i} mail me at user{i}@host{i}.example.com soon") for i in range(12)]
    rows += [(100, "please mail me at user1234#nohost soon"), (101, "mail me at someone99887@intranet soon"), (102, "nothing 998877 to see")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[-2][1].index("someone")
    assert got[101]["n_found"] == 1 and got[101]["spans"] == f"email:{at}:{at + 21}" and got[101]["n_email"] == 0
    assert got[102]["n_found"] == 0 and got[3]["spans"] == ",".join(base(rows[3][1]))


def test_value_under_many_trusted_patterns_is_found(spark):
    """25 patterns whose noisy or rounds to 1."""
    rows = [(100 * k + i, f"hello word{'abcdefghijklmnopqrstuvwxy'[k]} me at user{i}@host{i}.example.com soon".replace("me at", f"me{'abcdefghijklmnopqrstuvwxy'[k]} at")) for k in range(25) for i in range(9)]
    unseen = [(10_000 + k, f"word{c} me{c} at someone99887@intranet next{c}") for k, c in enumerate("abcdefghijklmnopqrstuvwxy")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows + unseen, "doc_id long, text string")).collect()}
    for i, t in unseen:
        at = t.index("someone")
        assert got[i]["n_found"] == 1 and got[i]["spans"] == f"email:{at}:{at + 21}" and got[i]["n_email"] == 0
    assert all(got[i]["n_found"] == 0 for i, _ in rows)


def test_part_of_a_base_span_is_found_where_it_stands_alone(spark):
    rows = [(i, f"please ring office +4420794609{i} now") for i in range(10, 22)] + [(i, f"word{i} thing {1000000 + i} other") for i in range(30, 40)]
    rows += [(100, "dial +1 (212) 555-1234 today"), (101, "so ring office 555-1234 now"), (102, "dial +1 (212) 555-9876 today"), (103, "a part labelled 555-9876 broke")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[-3][1].index("555")
    assert got[101]["n_found"] == 1 and got[101]["spans"] == f"phone:{at}:{at + 8}" and got[101]["n_phone"] == 0
    assert got[100]["n_found"] == 0 and got[100]["n_phone"] == 1 and got[103]["n_found"] == 0


# 9 nearest neighbours


def test_ann_odd_and_ties(spark):
    rows = [(i, [float(i % 5), 1.0], 0) for i in range(60)] + [(100, None, 0), (101, [0.0, 0.0], 0), (102, [float("nan"), 1.0], 0), (103, [1.0, None], 0), (104, [1.0], 0), (None, [1.0, 1.0], 0), (7, [2.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")
    got = ann.nearest(vectors, k=10, query_condition=F.col("vec_id") % 20 == 0).toPandas()
    ok = [(i, v) for i, v, _ in rows if i is not None and i < 100]
    for q in (0, 20, 40):
        d = sorted((abs((q % 5) - v[0]), i) for i, v in ok if i != q)[:10]
        assert [(r.score, r.vec_id) for r in got[got.query_id == q].sort_values("rank").itertuples()] == d
    assert ann.nearest(vectors.where("false"), query_condition=F.col("vec_id") % 20 == 0).count() == 0
    assert len(ann.nearest(vectors.where("vec_id in (0, 1)"), query_condition=F.col("vec_id") == 0).collect()) == 1


def test_ann_with_many_shards_and_blocks(spark, monkeypatch):
    """Several trees and query blocks, repeated query rows among them, equal brute force; one plan whatever the blocks."""
    rnd = np.random.default_rng(4)
    x = rnd.integers(-3, 4, (400, 3)).astype(float) + 0.5
    rows = [(i, x[i].tolist()) for i in range(400)] + [(40, [9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SHARD_ROWS", 60)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    want = Counter()
    for i, v in rows:
        if i % 10 == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i)[:4]
            want.update((i, k + 1, j, round(s, 9)) for k, (s, j) in enumerate(d))
    got = ann.nearest(vectors, k=4, query_condition=F.col("vec_id") % 10 == 0).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == want


def test_ann_factor_trades_recall():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 8))
    tree = ann.Tree(np.arange(3000), x, leaf=32)
    q = np.arange(0, 3000, 100)
    d = ann.distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    exact = tree.search(q, x[q], 10, 1.0)[0]
    loose = tree.search(q, x[q], 10, 1.3)[0]
    assert (exact == want).all() and 0.8 < np.mean([len(set(a) & set(b)) / 10 for a, b in zip(loose, want)]) <= 1


# 10 n-gram Jaccard join


def naive_components(rows, table=str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_odd(odd_docs, no_docs):
    got = ngram_jaccard.jaccard_classes(odd_docs)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == naive_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert ngram_jaccard.jaccard_classes(no_docs).count() == 0


@pytest.mark.parametrize("hot, tile", [(64, 2048), (2, 8), (0, 3)])
def test_jaccard_with_hot_passages_and_tiles(spark, monkeypatch, hot, tile):
    """Many near copies and a passage in most documents, with limits so low that tokens are hot and tiles many."""
    monkeypatch.setattr(ngram_jaccard, "TILE_ROWS", tile)
    monkeypatch.setattr(ngram_jaccard, "BRANCH", 3)
    rnd = np.random.default_rng(2)
    word = lambda: f"w{rnd.integers(0, 500)}"
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(12):
        core = [word() for _ in range(60)]
        for c in range(int(rnd.integers(1, 7))):
            own = list(core)
            for _ in range(int(rnd.integers(0, 4))):
                own[int(rnd.integers(0, 60))] = word()
            rows.append((len(rows), " ".join(own + (passage if g % 3 else []))))
    rows += [(len(rows) + i, " ".join(passage + [word()] * i)) for i in range(8)]
    old = ngram_jaccard.HOT
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    try:
        ngram_jaccard.HOT = hot
        monkeypatch.setattr(ngram_jaccard, "_meetings", _with_hot(ngram_jaccard._meetings, hot))
        monkeypatch.setattr(ngram_jaccard, "_postings", _with_hot(ngram_jaccard._postings, hot))
        got = ngram_jaccard.jaccard_classes(docs)
        assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == naive_components(rows)
    finally:
        ngram_jaccard.HOT = old


def _with_hot(f, hot):
    """Workers import the module afresh, so they are told the limit."""

    def run(batches):
        from treeline.llm import ngram_jaccard as m

        old, m.HOT = m.HOT, hot
        try:
            yield from f(batches)
        finally:
            m.HOT = old

    return run


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == got[102] == 100
    assert components.components(links.where("false"), "a", "b").count() == 0


# pipeline


def test_pipeline(spark, sf, texts, tiktoken_own):
    import corpus_pipeline as cp

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), texts
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == cp.COLUMNS
        got = set(r["doc_id"] for r in docs.select("doc_id").collect())
        rows = list(zip(kept.doc_id, kept.text))
        if name == "exact_dedup":
            assert got == {k[0] for k in naive_dedup(rows) if k[3]}
        elif name == "near_dedup":
            assert got == {k[0] for k in naive_components(rows) if k[0] == k[2]}
        elif name == "mix":
            assert got == set(kept.doc_id)
        kept = kept[kept.doc_id.isin(got)]
    last = cp.run(spark, sf).toPandas().sort_values("doc_id")
    assert last.n_tokens.tolist() == [digests(tiktoken_own, t)[0] for t in kept.text]


def test_pipeline_stages_on_odd_rows(spark, sf, odd_docs, no_docs, tiktoken_own):
    import corpus_pipeline as cp

    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for name, stage in cp.STAGES:
        made = stage(spark, odd_docs, sf)
        got = made.collect()
        assert stage(spark, no_docs, sf).count() == 0 and (name == "tokens" or made.columns == cp.COLUMNS)
        if name == "tokens":
            assert Counter(tuple(r)[1:4] for r in got) == Counter(digests(tiktoken_own, t or "") for _, t in rows)
            continue
        kept = Counter((r["doc_id"], r["text"]) for r in got)
        if name == "quality":  # rows of one text stay or go together
            texts = {t for _, t in kept}
            assert kept == Counter(r for r in rows if r[1] in texts)
        elif name == "exact_dedup":
            assert Counter(i for i, _ in kept.elements()) == Counter({i: k for (i, _, _, stays, _), k in naive_dedup(rows).items() if stays})
        elif name == "near_dedup":
            want = Counter()
            for (i, _, least), k in naive_components(rows).items():
                want[i] += k * (i == least)
            assert Counter(i for i, _ in kept.elements()) == +want
        else:
            assert kept == Counter(rows)
            assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixing.mix(odd_docs).orderBy("slot", "place").collect()]
