"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, operator by operator."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cityflux.llm import chat, language, licenses, lm, mixing, neighbours, packing, quality, simhash, urls
from cityflux.llm.components import components

PROSE = "the quick brown fox jumps over the lazy dog while many other small animals watch from the green hill and wait "
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, word string, count long, fp long, rank int"


def frame(spark, rows):
    """Documents with columns named like those the operators make themselves."""
    return spark.createDataFrame([(*r, None, 1, "x", 2, 3, 4) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    return frame(spark, [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, long_, "en", "b"), (5, "Ä ö", "de", "b"), (5, "Ä ö", "de", "b"), (None, "abc def", None, None), (7, "a\x00b ?? 12", "en", "b")])


def test_chat_edges(spark):
    rows = [(1, 2, "user", "b[/INST]"), (1, 1, "user", None), (1, 1, None, "[\\MORE]"), (1, 3, "assistant", "x</s>"), (1, 3, "assistant", "x</s>"), (None, 0, "assistant", ""), (2, None, "tool]", "[INST]"), (2, None, "tool]", "<\\\\/s>")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r[0]: [(t["role"], t["text"]) for t in r[1]] for r in made.select("conv_id", chat.parse(F.col("formatted"))).collect()}
    assert back[1] == [("", "[\\MORE]"), ("user", ""), ("user", "b[/INST]"), ("assistant", "x</s>"), ("assistant", "x</s>")]
    assert back[None] == [("assistant", "")] and back[2] == [("tool]", "<\\\\/s>"), ("tool]", "[INST]")]
    one = made.filter("conv_id = 1").first()
    assert "".join(s["text"] for s in one["segments"]) == one["formatted"]
    assert one["formatted"].count("</s>") == 3 and one["formatted"].count("[MORE]") == 2
    assert made.filter("conv_id = 1").select(chat.loss_text(F.col("segments"))).first()[0] == "x</s>x</s>"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(empty)).count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "it's\nthe 's", "a\u00a0 b", "x\x1fy z", "1,000.5 \u00b2", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\nb c", "<|endoftext| >", "\n", "a\tb", "\u00e9 \u4e2d\u6587 \U0001f600 b", "a\x00 b"]
    assert whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    for coder in (packing.Encoder("byte_bpe_50k.tiktoken"), packing.Encoder("byte_bpe_50k.json"), packing.Encoder("byte_bpe_50k.tiktoken")):
        assert [list(x) for x in coder.encode(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(4, 200))
    counts = {int(s): int(n) for s, n in zip(rng.integers(1, capacity + 1, 30), rng.integers(1, 5_000, 30))}
    planned = packing.plan(counts, capacity)
    held = Counter()
    for filling, many in planned:
        assert sum(filling) <= capacity
        for s in filling:
            held[s] += many
    assert held == counts
    best_fit = sum(n for _, n in packing._best_fit(counts, capacity))
    assert sum(n for _, n in planned) <= best_fit * 1.02 + 1


def test_packing_edges(spark, odd):
    rows = packing.pack(odd).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 1, 7: 1})
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(odd.limit(0)).count() == 0
    ids = packing.sequences(odd.filter("doc_id in (1, 4)"), packing.pack(odd.filter("doc_id in (1, 4)"))).collect()
    assert max(len(r["ids"]) for r in ids) <= 2048 and sum(len(r["ids"]) for r in ids) == sum(r["length"] for r in rows if r["doc_id"] in (1, 4))


def test_language_edges(spark, odd):
    told = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert {d: told[d]["lang_pred"] for d in (1, 2, 3)} == dict.fromkeys((1, 2, 3), "und") and told[1]["score"] == 0
    assert told[None]["held_out"] and language.identify(odd.limit(0)).count() == 0
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(none).collect()} == {"und"} and language.keep_identified(none).count() == odd.count()
    assert language.keep_identified(odd).columns == odd.columns


def test_language_model_sums_to_one():
    words = pa.array(["abab", "abba", "baba", "cab"])
    grams, _ = language._grams(words)
    model = language.Model.learn(*np.unique(grams, return_counts=True))
    # After any context the seen characters, and all others at the unseen one's share, sum to one.
    chars = [ord(c) for c in "abc"] + [language._END]
    before = (language._PAD << 48) | (ord("a") << 32) | (ord("b") << 16)
    seen = np.exp(model.score(np.array([before | c for c in chars], np.uint64)))
    other = np.exp(model.score(np.array([before | 999], np.uint64)))[0]
    assert seen.sum() + other * (language.ALPHABET - len(chars)) == pytest.approx(1)


def test_language_rejects_noise(spark):
    rng = np.random.default_rng(1)
    plain = [(i, " ".join(rng.permutation(PROSE.split())), "en", "a") for i in range(120)]
    noise = [(1000, " ".join("".join(rng.choice(list("qzxjkvwq"), 7)) for _ in range(300)), "en", "a")]
    kept = {r["doc_id"] for r in language.keep_identified(frame(spark, plain + noise), language.fit(frame(spark, plain))).collect()}
    assert kept == {r[0] for r in plain}


def test_lm_edges(spark, odd):
    rows = lm.score(odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score(odd.limit(0)).count() == 0
    unlearned = lm.score(odd.filter("doc_id is null")).first()
    assert unlearned["train_tokens"] == 0 and unlearned["base_score"] == 0 and unlearned["n_known"] == 0


def test_lm_gradients_and_states():
    rng = np.random.default_rng(0)
    net = lm.Network.start(np.array([5, 9, 3, 2, 1, 1]), np.array([0, 1, 3, 6]), hidden=4)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    tokens, targets = rng.integers(0, 6, (2, 7, 3))
    fresh = tokens == 0
    start = rng.normal(size=(3, 4))
    g, _, _ = net.gradients(start, tokens, targets, fresh)
    for name, v in net.w.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        means = []
        for sign in (1, -1):
            v[at] += sign * 1e-5
            means.append(net.gradients(start, tokens, targets, fresh)[2])
            v[at] -= sign * 1e-5
        assert -(means[0] - means[1]) / 2e-5 == pytest.approx(g[name][at], abs=1e-7)
    net.w = {k: v.astype(np.float32) for k, v in net.w.items()}
    texts = [rng.integers(1, 6, n) for n in (5, 90, 0, 33)]
    flat = np.concatenate([np.append(t, 0) for t in texts])
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    together, alone = net.score(flat, first, window=7), [net.score(np.append(t, 0), np.array([0, len(t) + 1]), window=200)[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-5)
    # A distribution over all tokens.
    every = net.log_probability(np.repeat(rng.normal(size=(1, 4)).astype(np.float32), 6, 0), np.arange(6))
    assert np.exp(every).sum() == pytest.approx(1, rel=1e-5)


def test_license_edges(spark, odd):
    apache = licenses.NOTICES[0][1]
    changed = licenses.NOTICES[6][1].replace("restriction", "limits")
    rows = [(1, f"{PROSE * 5}\n{apache.upper()}\n{PROSE}", None, None), (2, changed, None, None), (3, "licensed under the apache software", None, None), (4, (apache + " ") * 300, None, None), (1, f"{PROSE * 5}\n{apache.upper()}\n{PROSE}", None, None)]
    found = {(r["doc_id"], r["license"]): r for r in licenses.scan(frame(spark, rows)).collect()}
    assert set(found) == {(1, "apache-2.0-short"), (2, "mit"), (4, "apache-2.0-short")}
    assert found[1, "apache-2.0-short"]["containment"] == 1 and 0.8 <= found[2, "mit"]["containment"] < 1
    assert licenses.scan(odd).count() == 0 and licenses.scan(odd.limit(0)).count() == 0


def test_quality_edges(spark, odd):
    rows = [(1, PROSE * 3, None, None), (2, " ".join(f"word{i}" for i in range(60)), None, None), (3, "### " * 80, None, None)]
    told = {r["doc_id"]: r for r in quality.judge(frame(spark, rows).unionByName(odd.filter("doc_id > 3 or text is null").withColumn("doc_id", F.col("doc_id") * 100 + 100))).collect()}
    assert not told[1]["kept"] and told[2]["kept"] and not told[3]["kept"] and told[200]["n_words"] == 0
    kept = quality.keep_quality(frame(spark, rows))
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == frame(spark, rows).columns
    assert quality.judge(odd.limit(0)).count() == 0
    for order in (quality.RULES, quality.RULES[::-1]):
        keeps = quality.let(quality.words(F.col("text")), _cascade(order))
        assert [r["doc_id"] for r in frame(spark, rows).filter(keeps).collect()] == [2]


def _cascade(order):
    return lambda w: quality.cascade(order, quality.features(F.col("text"), w))


def test_fit_is_exact_where_lengths_allow():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 5, len(lengths)) if rng.random() < 0.5 else np.ones(len(lengths), int)
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget, gap=10_000)
        assert ((0 <= take) & (take <= counts)).all()
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + int(n) * k for s in sums for k in range(c + 1)}
        got = int((lengths * take).sum())
        nearest = min(abs(s - budget) for s in sums)
        # Only the even share taken first can stand in the way of the nearest sum.
        assert nearest <= abs(got - budget) < lengths.max()
        if (counts == 1).all():
            assert abs(got - budget) == nearest


def test_mixing_edges(spark, odd):
    rows = mixing.mix(odd.drop("size")).collect()
    assert len(rows) == odd.count() and sum(r["source"] is None for r in rows) == 2
    assert mixing.mix(odd.limit(0)).count() == 0
    copies = frame(spark, [(i % 50, "one two three", None, "a") for i in range(600)] + [(900 + i, "x y", None, "b") for i in range(30)])
    small, large = (sorted(map(tuple, mixing.mix(copies, per_bucket=n).select("doc_id", "source", "times").collect()), key=str) for n in (7, 100_000))
    assert small == large
    assert mixing.mixed(copies).columns == copies.columns


def test_mixing_columns_of_any_name(spark):
    names = ["n", "picked", "repeats", "_limit", "_key", "_copy", "_bucket", "_row", "_rank", "count", "times", "size", "target"]
    plain = frame(spark, [(i % 40, "one two three", None, "a") for i in range(300)] + [(900 + i, "x y", None, "b") for i in range(30)]).select("doc_id", "text", "source")
    named = plain.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in names])
    want = Counter(r["doc_id"] for r in mixing.mixed(plain).collect())
    rows = mixing.mixed(named).collect()
    assert Counter(r["doc_id"] for r in rows) == want
    assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in names)
    taken = mixing.mix(named)
    assert {r["doc_id"] for r in taken.filter("times > 0").collect()} == set(want)
    assert all(r["picked"] == f"picked-{r['doc_id']}" and r["_key"] == f"_key-{r['doc_id']}" for r in taken.collect())


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://WWW.Example.COM/en/x?y"), (4, "https://net/es/"), (5, "ftp://a.net"), (5, "ftp://a.net"), (6, "http://com?x"), (7, "x://y://z/p")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    rows = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, none).na.fill("-").collect())
    assert rows == [(1, "", "", "-", "allow"), (2, "", "", "-", "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "net", "/es/", "net/es/", "block"), (5, "a.net", "", "-", "allow"), (5, "a.net", "", "-", "allow"), (6, "com", "", "-", "allow"), (7, "y:", "//z/p", "-", "allow")]
    assert urls.judge(pages.limit(0), none).count() == 0


def test_url_rules_are_mined(spark):
    rows = [(f"http://{h}.org/{p}/{i}", h == "spam" and p == "win") for i in range(60) for h in ("spam", "good") for p in ("win", "news")]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    found = [(r["rule"], r["confidence"]) for r in urls.mine(labelled).collect()]
    assert found == [(["host=spam", "path=win"], 1.0)]
    pages = spark.createDataFrame([(1, "http://spam.org/win/x"), (2, "http://spam.org/news"), (3, "http://good.org/win")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, None)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)}


def test_links_find_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    prints = set(map(int, base))
    for x in base:
        for _ in range(6):
            y = int(np.uint64(np.int64(x).view(np.uint64)))
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            prints.add(int(np.uint64(y).view(np.int64)))
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_edges(spark, odd):
    told = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=str)
    by = {d: (fp, c) for d, fp, c in told}
    assert len(told) == odd.count() and {by[d] for d in (1, 2, 3)} == {(0, 1)} and by[None][1] is None
    kept = simhash.keep_one(odd)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 5, 7] and kept.columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.keep_one(odd.limit(0)).count() == 0
    same = frame(spark, [(9, PROSE, None, None), (9, "other text entirely of its own", None, None), (8, PROSE, None, None), (None, PROSE, None, None)])
    assert sorted((r["doc_id"], r["text"][:5]) for r in simhash.keep_one(same).collect()) == [(8, "the q"), (9, "other")]


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [5.0, 1.0]), (8, [-1.0, 0.0]), (None, [9.0, 9.0]), (9, [1.0]), (40, [float("inf"), 1.0]), (1, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, block int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(table, neighbours.every(table), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 7, 5.0), (20, 2, 1, 1.0), (20, 3, 1, 1.0)]
    other = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (20, [1.0, 2.0]), (21, [2.0, 1.0]), (21, [3.0, 1.0]), (22, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.search(other, neighbours.every(other)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 22, 3.0), (20, 1, 21, 5.0), (20, 2, 21, 4.0)]
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0


def test_neighbours_among_copies_and_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(600, 8)), 3)
    x[200:400] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, neighbours.every(table), k=20, block=100, group=9, share=1.0).collect()
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:20]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_quality_order_prefers_cheap_rejection(spark):
    rows = frame(spark, [(i, "bad", None, None) for i in range(300)])
    order = quality.ordered_rules(rows)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES) and order[-1].name != "few_words"
