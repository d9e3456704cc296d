"""Queries of the corpus operators against SQL or brute force over a whole small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, difference

from cityflux.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus == 2


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert difference(connect(sf), ORACLES[name], QUERIES[name](spark, sf)) is None


def test_chat_added_conversation(spark, sf):
    row = QUERIES["op1_chat_format"](spark, sf).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_packing_round_trip(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op2_best_fit_packing"](spark, sf).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == docs.keys()
    tokens = 0
    for doc_id, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(docs[doc_id]["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert len(pieces) == 1 or k == 0 or p["length"] == 2048
            at += p["length"]
        assert at == len(ids)
        tokens += at
    for held_ in by_seq.values():
        at = 0
        for offset, length in sorted(held_):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_seq) <= -(-tokens // 2048) * 1.01 + 1


def test_language_on_held_out(spark, sf, docs):
    rows = QUERIES["op3_language_id"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 4) and 0 <= r["score"] <= 1
    known = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in known)
    assert right >= 0.95 * len(known)


def test_lm_base_and_gain(spark, sf, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op4_lm_scoring"](spark, sf).collect()}
    words = {d: [*WORD.findall(ascii_lower(r["text"] or "")), None] for d, r in docs.items()}
    counts = Counter(w for d, ws in words.items() if not held(d, 7) for w in ws)
    n, v = sum(counts.values()), len(counts)
    sums = np.zeros(3)
    for d, ws in words.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(d, 7), len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if r["held_out"]:
            sums += [len(ws), base, r["score"]]
    assert sums[2] > sums[1]


def test_mixing_against_plan(spark, sf, docs):
    rows = QUERIES["op7_source_mixing"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes = {d: len(WORD.findall(r["text"] or "")) for d, r in docs.items()}
    whole = Counter()
    for d, r in docs.items():
        whole[r["source"]] += sizes[d]
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, total, capped = {}, sum(whole.values()), set()
    while True:
        left = total - sum(3 * whole[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * whole[s] if s in capped else left * weight[s] / open_ for s in names}
        above = {s for s in names if target[s] > 3 * whole[s]}
        if above <= capped:
            break
        capped |= above
    taken = Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == whole[d["source"]]
        assert r["target"] == pytest.approx(target[d["source"]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[d["source"]] += r["taken"]
    for s in names:
        # These sources have some ten documents each: not every sum can be reached.
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], min(sizes[d] for d in docs if docs[d]["source"] == s))
    again = QUERIES["op7_source_mixing"](spark, sf)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))


def test_url_rules_by_hand(spark, sf):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op8_url_filters"](spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", pages[r["page_id"]] or "")
        host, path = (ascii_lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, what) for what, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits)[1:]
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_brute_force(spark, sf, docs):
    rows = QUERIES["op9_simhash_near_dedup"](spark, sf).collect()
    prints = {d: fingerprint(r["text"]) for d, r in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{prints[d]:016x}", find(d)) for d in docs}


def test_neighbours_recall(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in given if r["embedding"]])
    x = np.array([r["embedding"] for r in given if r["embedding"]], float)
    got = defaultdict(list)
    for r in QUERIES["op10_nearest_neighbours"](spark, sf).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(len(ids)):
        if ids[q] % 20:
            continue
        scores = x @ x[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in mine)
        hits += len({m[1] for m in mine} & set(ids[best]))
        total += len(best)
    assert hits >= 0.9 * total
