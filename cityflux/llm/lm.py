"""LM scoring: a gated recurrent word model and a unigram base, over whole documents.

Word counts cover all training documents and stay in a table. The recurrent model predicts the commonest words
themselves and every other word as one of some suffix buckets; a word within its bucket has its smoothed count's
share. So a score needs the model and the counts: those of common words travel with the tasks, a bounded number;
those of rare words are joined. The network has one gated layer, a class-factored output (class, then word within
its class), and learns by truncated backpropagation with its state carried from window to window; scoring carries
the state through the whole document, many documents in step.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.llm.common import chunks, flat_words
from cityflux.llm.language import learns
from cityflux.plans.scratch import materialize

MODULUS = 7
# Words whose counts travel with the tasks: at most so many, each of at most so many bytes.
HEAD, HEAD_BYTES = 300_000, 64
# Tokens of the recurrent model: commonest words with the end of a text, and suffix buckets.
VOCABULARY, BUCKETS = 1_024, 64
HIDDEN, CLASSES = 16, 32
# Learning: in a pass the training documents are dealt over so many rounds, each document whole in one of them; after a round weights are averaged.
PASSES, ROUNDS = 1, 3
# Shards learning side by side hold about so many tokens. A shard is read by as many streams as make about STEPS windows, STREAMS at most.
SHARD_TOKENS, STEPS, STREAMS, WINDOW = 2_500_000, 160, 512, 24
RATE, DECAY = 0.04, 0.9
# Bytes of text, and of tokens (two each), that a worker holds at a time.
BLOCK_BYTES, TOKEN_BYTES = 12_000_000, 6_000_000
# The end of a text in tables of words: no word is empty.
END = ""


# --- the network ----------------------------------------------------------------------------


def _streams(texts: list[np.ndarray], streams: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets (time by stream, the longest stream first, filled up with ends) and which of them are real.

    Each text goes to the stream that is shortest so far, as if it were refilled when its text ends. A text longer
    than a stream's share is read in parts, so that the streams end as close to each other as they can.
    """
    share = max(1, -(-sum(map(len, texts)) // streams))
    texts = [x[k : k + share] for x in texts for k in range(0, len(x), share)]
    waiting, dealt = [(0, k) for k in range(streams)], [[] for _ in range(streams)]
    for text in texts:
        size, k = heapq.heappop(waiting)
        dealt[k].append(text)
        heapq.heappush(waiting, (size + len(text), k))
    held = sorted((np.concatenate(x) for x in dealt), key=len, reverse=True)
    sizes = np.array([len(x) for x in held])
    targets = np.full((sizes[0], streams), end, held[0].dtype)
    for k, x in enumerate(held):
        targets[: len(x), k] = x
    return targets, np.arange(sizes[0])[:, None] < sizes


@dataclass
class Network:
    """Weights by name; tokens are numbered so that a class is a run of them: [bounds[k], bounds[k + 1])."""

    w: dict[str, np.ndarray]
    bounds: np.ndarray
    end: int = 0

    @staticmethod
    def start(counts: np.ndarray, bounds: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> Network:
        """Small random weights; output biases at the logs of the counts, so that it begins as a unigram model."""
        rng = np.random.default_rng(seed)
        n, classes = len(counts), len(bounds) - 1
        logs = np.log(counts + 1.0)
        by_class = np.array([np.logaddexp.reduce(logs[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])
        w = {
            "into": rng.normal(0, 0.1, (n, 3 * hidden)),
            "loop": rng.normal(0, 0.1, (hidden, 3 * hidden)),
            "classes": rng.normal(0, 0.05, (hidden, classes)),
            "class_bias": by_class - np.logaddexp.reduce(by_class),
            "words": rng.normal(0, 0.05, (n, hidden)),
            "word_bias": logs - np.repeat(by_class, np.diff(bounds)),
        }
        return Network({k: v.astype(np.float32) for k, v in w.items()}, bounds)

    @property
    def hidden(self) -> int:
        return self.w["loop"].shape[0]

    def step(self, h: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and what its gradient needs."""
        k = self.hidden
        x, u = self.w["into"][tokens], h @ self.w["loop"]
        gates = 0.5 * np.tanh(0.5 * (x[:, : 2 * k] + u[:, : 2 * k])) + 0.5
        z, r = gates[:, :k], gates[:, k:]
        c = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
        return h + z * (c - h), z, r, c, u[:, 2 * k :]

    def _owner(self, targets: np.ndarray) -> np.ndarray:
        """The class of each token; in two bytes, which numpy sorts by digits."""
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.uint16), np.diff(self.bounds)).take(targets)

    def _by_class(self, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(self.bounds)))
        for k in range(len(self.bounds) - 1):
            if ends[k] < ends[k + 1]:
                yield k, order[ends[k] : ends[k + 1]]

    def log_probability(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        # Tokens along the last axis: numpy reduces over the few rows of a class far faster than along many short ones.
        logits = self.w["classes"].T @ states.T + self.w["class_bias"][:, None]
        top = logits.max(0)
        rest = logits - top
        norm = np.log(np.exp(rest, out=rest).sum(0)) + top
        out = np.empty(len(targets), np.float32)
        for k, rows in self._by_class(self._owner(targets)):
            a, b = self.bounds[k], self.bounds[k + 1]
            own = self.w["words"][a:b] @ states[rows].T
            own += self.w["word_bias"][a:b, None]
            own -= own.max(0)
            inside = own[targets[rows] - a, np.arange(len(rows))]
            inside -= np.log(np.exp(own, out=own).sum(0))
            out[rows] = logits[k, rows] - norm[rows] + inside
        return out

    def gradients(self, h: np.ndarray, tokens: np.ndarray, targets: np.ndarray, fresh: np.ndarray, real: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients over one window (time by stream) from state h, the last state, and the mean log probability.

        ``fresh`` marks where a stream begins a new text: its state starts from zero there. Targets that are not
        ``real`` stand after a stream's end and count for nothing.
        """
        counts = np.ones(targets.size, bool) if real is None else real.ravel()
        steps, before = [], np.empty((len(tokens), *h.shape), h.dtype)
        states = np.empty_like(before)
        for t in range(len(tokens)):
            before[t] = h * ~fresh[t][:, None]
            h, *kept = self.step(before[t], tokens[t])
            steps.append(kept)
            states[t] = h
        flat, aims = states.reshape(-1, self.hidden), targets.ravel()
        g = {name: np.zeros_like(v) for name, v in self.w.items()}
        # As in log_probability, tokens lie along the last axis.
        p = self.w["classes"].T @ flat.T
        p += self.w["class_bias"][:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        owner, at, all_count = self._owner(aims), np.arange(len(aims)), bool(counts.all())
        total = np.log(p[owner, at] + 1e-30)[counts].sum()
        p[owner, at] -= 1
        if not all_count:
            p[:, ~counts] = 0
        g["classes"], g["class_bias"] = flat.T @ p.T, p.sum(1)
        back = p.T @ self.w["classes"].T
        for k, rows in self._by_class(owner):
            rows = rows if all_count else rows[counts[rows]]
            if not len(rows):
                continue
            a, b = self.bounds[k], self.bounds[k + 1]
            states_k, at = flat[rows], np.arange(len(rows))
            q = self.w["words"][a:b] @ states_k.T
            q += self.w["word_bias"][a:b, None]
            q -= q.max(0)
            np.exp(q, out=q)
            q /= q.sum(0)
            total += np.log(q[aims[rows] - a, at] + 1e-30).sum()
            q[aims[rows] - a, at] -= 1
            g["words"][a:b] = q @ states_k
            g["word_bias"][a:b] = q.sum(1)
            back[rows] += q.T @ self.w["words"][a:b]
        back = back.reshape(len(tokens), -1, self.hidden)
        carried, inputs = np.zeros_like(h), np.empty((*tokens.shape, 3 * self.hidden), back.dtype)
        looped, k = np.empty_like(inputs), self.hidden
        for t in range(len(tokens) - 1, -1, -1):
            z, r, c, u = steps[t]
            d = back[t] + carried
            dc = d * z * (1 - c * c)
            inputs[t, :, :k] = d * (c - before[t]) * z * (1 - z)
            inputs[t, :, k : 2 * k] = dc * u * r * (1 - r)
            inputs[t, :, 2 * k :] = dc
            looped[t, :, : 2 * k] = inputs[t, :, : 2 * k]
            looped[t, :, 2 * k :] = dc * r
            carried = (d * (1 - z) + looped[t] @ self.w["loop"].T) * ~fresh[t][:, None]
        g["loop"] = before.reshape(-1, k).T @ looped.reshape(-1, 3 * k)
        order = np.argsort(tokens.ravel().astype(np.uint16), kind="stable")
        met = tokens.ravel()[order]
        runs = np.flatnonzero(np.diff(met, prepend=-1))
        g["into"][met[runs]] = np.add.reduceat(inputs.reshape(tokens.size, -1)[order], runs)
        many = max(1, int(counts.sum()))
        return {name: v / many for name, v in g.items()}, h, float(total) / many

    def fit(self, texts: list[np.ndarray], streams: int = STREAMS, window: int = WINDOW, rate: float = RATE, decay: float = DECAY) -> list[float]:
        """One pass over the texts (each ends with the end token) by Adam; the mean log probability of each window.

        Every token is a target once. A stream that ends its text goes on with the next text; when none is left
        it ends, and the others go on.
        """
        targets, real = _streams(texts, max(1, min(streams, len(texts))), self.end)
        length, streams = targets.shape
        tokens = np.vstack((np.full((1, streams), self.end, targets.dtype), targets[:-1]))
        fresh = tokens == self.end
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        h, said, seen = np.zeros((streams, self.hidden), np.float32), [], 0
        for n, t in enumerate(range(0, length, window), 1):
            # Streams end from the right: those that have no target left in the window are cut off.
            live = int(real[t].sum())
            h, cut = h[:live], np.s_[t : t + window, :live]
            g, h, mean = self.gradients(h, tokens[cut], targets[cut], fresh[cut], real[cut])
            said.append(mean)
            # Steps get smaller towards the end, and where few live streams make a rough gradient.
            share = np.sqrt(live / streams) * (1 - decay * seen / real.sum())
            seen += int(real[t : t + window].sum())
            for name, v in g.items():
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                self.w[name] -= (share * rate * first[name] / (1 - 0.9**n) / (np.sqrt(second[name] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return said

    def score(self, flat: np.ndarray, first: np.ndarray, window: int = 32) -> np.ndarray:
        """Natural-log probability of every text; text i is flat[first[i]:first[i + 1]] and ends with the end token."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        sums = np.zeros(len(order))
        h = np.zeros((len(order), self.hidden), np.float32)
        last = np.full(len(order), self.end)
        for t0 in range(0, int(size[0]) if len(size) else 0, window):
            states, aims, rows = [], [], []
            for t in range(t0, min(t0 + window, int(size[0]))):
                live = int(np.searchsorted(-size, -t, side="left"))
                h[:live], *_ = self.step(h[:live], last[:live])
                last[:live] = flat[start[:live] + t]
                states.append(h[:live].copy())
                aims.append(last[:live].copy())
                rows.append(np.arange(live))
            logs = self.log_probability(np.concatenate(states), np.concatenate(aims))
            sums += np.bincount(np.concatenate(rows), logs, len(order))
        out = np.empty(len(order))
        out[order] = sums
        return out


# --- counts ---------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all training documents; the end of texts is the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=BLOCK_BYTES):
                words, _ = flat_words(part.column("text"), lower=True)
                coded = words.dictionary_encode()
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.array([END])]), pa.array(np.append(counts, len(part)))], names=["word", "c"])

    taught = docs.filter(learns(F.col("doc_id"), MODULUS)).select("text")
    return taught.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _bucket_of(words: pa.Array) -> np.ndarray:
    ends = pc.utf8_slice_codeunits(words, start=-2).dictionary_encode()
    own = np.array([zlib.crc32(x.encode()) % BUCKETS for x in ends.dictionary.to_pylist()], np.int64)
    return own[ends.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


@dataclass
class Scorer:
    """What a task needs: common words with their counts, which of them are tokens, bucket sums, the network."""

    words: pa.Array
    counts: np.ndarray
    token: np.ndarray
    bucket_token: np.ndarray
    bucket_log: np.ndarray
    network: Network

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens with ends, first token of each text, words without ends, their first, place of each word among the distinct, distinct words, their place in the head or -1)."""
        words, first = flat_words(texts, lower=True)
        coded = words.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        token = np.where(place >= 0, self.token[place], -1)
        token = np.where(token >= 0, token, self.bucket_token[_bucket_of(coded.dictionary)])
        at = coded.indices.to_numpy()
        n = np.diff(first)
        starts = np.concatenate(([0], np.cumsum(n + 1)))
        flat = np.empty(starts[-1], np.int64)
        flat[np.arange(len(at)) + np.repeat(np.arange(len(n)), n)] = token[at]
        flat[starts[1:] - 1] = self.network.end
        return flat, starts, first, at, coded.dictionary, place


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def _scorer(counts: DataFrame) -> tuple[Scorer, int, int]:
    """The untrained scorer, all training tokens, distinct ones."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The least count such that no more than HEAD words have it or more.
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES)
    by_count = sorted(((r["c"], r["n"]) for r in short.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    sums = np.cumsum([n for _, n in by_count])
    fits = int(np.searchsorted(sums, HEAD, side="right"))
    least = by_count[fits - 1][0] if fits else None
    head = short.filter(F.col("c") >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
    head = head.sort_by([("c", "descending"), ("word", "ascending")])
    words, c = head["word"].combine_chunks().cast(pa.string()), head["c"].to_numpy().astype(np.int64)
    inside = np.flatnonzero(~np.isin(np.arange(len(words)), np.flatnonzero(pc.equal(words, END).to_numpy(zero_copy_only=False))))[: VOCABULARY - 1]
    known = set(words.take(pa.array(inside)).to_pylist()) | {END}
    bucket = F.crc32(F.right("word", F.lit(2))) % BUCKETS
    rest = counts.filter(~F.col("word").isin(sorted(known))).groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    bucket_sum, bucket_words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rest:
        bucket_sum[r["b"]], bucket_words[r["b"]] = r["c"], r["n"]
    ends = int(c[pc.index(words, END).as_py()]) if pc.index(words, END).as_py() >= 0 else 0
    # Tokens by falling count, the end first; classes have about equal sums of square roots of counts.
    sizes = np.concatenate(([ends], c[inside], bucket_sum))
    order = np.concatenate(([0], 1 + np.argsort(-sizes[1:], kind="stable")))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    weight = np.sqrt(sizes[order] + 1)
    owner = np.minimum((np.cumsum(weight) - weight / 2) / weight.sum() * CLASSES, CLASSES - 1).astype(int)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(order)]))
    token = np.full(len(words) + 1, -1, np.int64)
    token[inside] = number[1 : 1 + len(inside)]
    network = Network.start(sizes[order], bounds)
    return Scorer(words, c, token, number[1 + len(inside) :], np.log10(bucket_sum + bucket_words + 1), network), int(total), int(distinct)


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights of several shards as one row: their sums, each times its tokens, and the tokens."""
    lists = [[np.frombuffer(b, np.float64) for b in row] for row in frame["w"]]
    return pd.DataFrame({"w": [[sum(own).tobytes() for own in zip(*lists)]], "n": [int(frame["n"].sum())]})


def _dealt(encoded: DataFrame) -> tuple[DataFrame, int]:
    """The training documents as tokens (part: the round that takes it, shard, h), and the number of shards of a round.

    Shards are bounded and grow in number with the tokens.
    """
    texts = encoded.filter(learns(F.col("doc_id"), MODULUS) & (F.col("n_tokens") > 1))
    tokens = texts.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-tokens // (ROUNDS * SHARD_TOKENS)))
    h = F.xxhash64("doc_id", "tokens")
    return texts.select(F.pmod(h, F.lit(ROUNDS)).alias("part"), F.pmod(F.shiftright(h, 20), F.lit(shards)).alias("shard"), h.alias("h"), "tokens"), shards


def _train(encoded: DataFrame, scorer: Scorer, passes: int) -> None:
    """Rounds of learning in shards from common weights, which are then averaged; weights, never texts, reach the driver.

    Averages are formed in Spark in two levels, and the driver gets one row.
    """
    dealt, shards = _dealt(encoded)
    fan, names, turns = int(np.ceil(np.sqrt(shards))), list(scorer.network.w), passes * ROUNDS

    def learner(turn: int):
        def learn(frame: pd.DataFrame) -> pd.DataFrame:
            own = [np.frombuffer(x, np.uint16).astype(np.int64) for x in frame.sort_values("h")["tokens"]]
            tokens = sum(map(len, own))
            streams = int(np.clip(tokens // (WINDOW * STEPS), 8, STREAMS))
            mine = Network({k: v.copy() for k, v in scorer.network.w.items()}, scorer.network.bounds)
            mine.fit(own, streams, WINDOW, RATE * (1 - turn / turns), DECAY)
            weights = [(mine.w[k].astype(np.float64) * tokens).tobytes() for k in names]
            return pd.DataFrame({"branch": [int(frame["shard"].iloc[0]) % fan], "w": [weights], "n": [tokens]})

        return learn

    for turn in range(turns):
        learned = dealt.filter(F.col("part") == turn % ROUNDS).groupBy("shard").applyInPandas(learner(turn), "branch int, w array<binary>, n long")
        branches = learned.groupBy("branch").applyInPandas(_summed, "w array<binary>, n long")
        told = branches.groupBy().applyInPandas(_summed, "w array<binary>, n long").first()
        if told:
            for i, k in enumerate(names):
                whole = np.frombuffer(told["w"][i], np.float64) / told["n"]
                scorer.network.w[k] = whole.astype(np.float32).reshape(scorer.network.w[k].shape)


def _encoded(docs: DataFrame, scorer: Scorer, ends: int) -> DataFrame:
    """Every document as tokens (two bytes each, the end last), with what counts of common words say, and its rare words (``tail``)."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        row = TaskContext.get().partitionId() << 33
        logs = np.append(np.log10(held.counts + 1.0), 0.0)
        for batch in batches:
            for part in chunks(batch, most=BLOCK_BYTES):
                flat, starts, first, at, words, place = held.encode(part.column("text"))
                common = place >= 0
                bucketed = held.token[place] < 0
                base = _sums(np.where(common, logs[place], 0.0)[at], first) + np.log10(ends + 1.0)
                own = np.where(common & bucketed, logs[place], 0.0) - np.where(bucketed, held.bucket_log[_bucket_of(words)], 0.0)
                share = _sums(own[at], first)
                known = _sums(common[at].astype(float), first).astype(np.int64) + (ends > 0)
                rare = ~common[at]
                of = np.concatenate(([0], np.cumsum(rare)))[first]
                tail = pa.ListArray.from_arrays(pa.array(of, pa.int32()), words.take(pa.array(at[rare])))
                cuts = pa.py_buffer((2 * starts).astype(np.int32).tobytes())
                tokens = pa.Array.from_buffers(pa.binary(), len(part), [None, cuts, pa.py_buffer(flat.astype(np.uint16).tobytes())])
                ids = pa.array(row + np.arange(len(part)))
                row += len(part)
                columns = [ids, part.column("doc_id"), pa.array(np.diff(starts)), pa.array(known), pa.array(base), pa.array(share), tokens, tail]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "known", "base", "share", "tokens", "tail"])

    schema = "row long, doc_id long, n_tokens long, known long, base double, share double, tokens binary, tail array<string>"
    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "tokens")


def score(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole document.

    Null and empty texts are the end token alone. A null doc_id is held out. Repeated rows are scored each, and
    count as often in training. Without training documents all counts are zero and the network keeps its start. Empty
    table: no rows. Other columns are left out. Counts, tokens, buckets and scores cover all documents; every pass learns from
    every token of every training document that has a word.
    """
    counts = materialize(word_counts(docs), "counts")
    scorer, total, distinct = _scorer(counts)
    ends = counts.filter(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    encoded = _encoded(docs, scorer, ends)
    _train(encoded, scorer, passes)
    sent = docs.sparkSession.sparkContext.broadcast(scorer.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "tokens", TOKEN_BYTES):
                texts = part.column("tokens")
                flat = np.frombuffer(b"".join(texts.to_pylist()), np.uint16).astype(np.int64)
                starts = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy() // 2)))
                model = sent.value.score(flat, starts) / np.log(10) + part.column("share").to_numpy()
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(model)], names=[*names, "model"])

    names = ["row", "doc_id", "n_tokens", "known", "base"]
    scored = encoded.select(*names, "share", "tokens").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, model double")
    rare = encoded.select("row", F.explode("tail").alias("word")).join(counts, "word").groupBy("row")
    found = rare.agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    both = scored.join(found, "row", "left").na.fill(0, ["more", "logs"])
    return both.select(
        "doc_id", (~learns(F.col("doc_id"), MODULUS)).alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("model") + F.col("logs")).alias("score"),
    )
