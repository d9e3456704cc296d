"""Language identification by interpolated Kneser-Ney character models.

Each language's model is learned from a bounded sample of its labelled documents, in a task of its own, and is
kept in sorted arrays of n-gram hashes with their log probabilities. Every distinct word of a block of
texts is scored once in every language; a text gets the language of least cross-entropy per character. What
counts as too high a cross-entropy, and how sure a choice is, is calibrated on sampled documents held back from the models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.llm.common import chunks, flat_words
from cityflux.plans.scratch import materialize

# The sample of a language: so many documents and characters at most. The bound is on learning only.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 400_000
ORDER = 4
# Unseen characters share this many places evenly.
ALPHABET = 65_536
UNKNOWN = "und"
BLOCK_BYTES = 3_000_000
# Headroom on the largest normalised excess seen in calibration (counted as this many deviations at least) before a text is rejected.
HEADROOM, DEVIATIONS = 1.5, 3.0
# Long documents of a language that only calibrate the rejection.
LONG_HELD = 16
_PAD, _END = 1, 2


def learns(doc_id: Column, modulus: int = 4, held_out: int = 2) -> Column:
    """Whether a document is not held out; a null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus != held_out, F.lit(False))


# --- n-grams --------------------------------------------------------------------------------


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ORDER-grams that end at every character, or end, of every word, and how many each word has.

    Characters are folded to 16 bits and packed; runs of what is no letter count as one blank.
    """
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{M}]+", " "), " ")
    sizes = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(plain.to_numpy(zero_copy_only=False)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) & np.uint64(0xFFFF)
    has = sizes > 0
    count = np.where(has, sizes + 1, 0)
    full = np.where(has, sizes + ORDER, 0)
    line = np.full(full.sum(), _PAD, np.uint64)
    starts = np.cumsum(full) - full
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes) + ORDER - 1
    line[inside] = codes
    line[(starts + full - 1)[has]] = _END
    grams = np.zeros(len(line), np.uint64)
    for back in range(ORDER):
        grams[ORDER - 1 :] |= line[ORDER - 1 - back : len(line) - back] << np.uint64(16 * back)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count) + ORDER - 1
    return grams[at], count


def _low(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters of n-grams."""
    return grams & np.uint64(2 ** (16 * order) - 1)


@dataclass
class Model:
    """Per order from 1: sorted n-gram hashes with log probabilities, sorted contexts with log back-off weights."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    @staticmethod
    def learn(grams: np.ndarray, counts: np.ndarray) -> Model:
        """From distinct ORDER-grams and how often each was seen."""
        seen = {ORDER: (grams, counts.astype(float))}
        for order in range(ORDER - 1, 0, -1):
            # Below the highest order an n-gram counts once for each different character before it.
            key, number = np.unique(_low(seen[order + 1][0], order), return_counts=True)
            seen[order] = key, number.astype(float)
        out = Model([], [], [], [])
        below = np.zeros(0)
        for order in range(1, ORDER + 1):
            key, number = seen[order]
            ones, twos = (number == 1).sum(), (number == 2).sum()
            cut = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
            context, at = np.unique(key >> np.uint64(16), return_inverse=True)
            total = np.bincount(at, number)
            spare = cut * np.bincount(at) / total
            lower = below[np.searchsorted(out.grams[-1], _low(key, order - 1))] if order > 1 else 1.0 / ALPHABET
            below = (number - np.minimum(cut, number)) / total[at] + spare[at] * lower
            out.grams.append(key)
            out.logs.append(np.log(below))
            out.contexts.append(context)
            out.weights.append(np.log(spare))
        return out

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each ORDER-gram given those before."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            key, known = _low(grams[open_], order), self.grams[order - 1]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            out[open_[hit]] += self.logs[order - 1][at[hit]]
            open_, key = open_[~hit], key[~hit] >> np.uint64(16)
            context = self.contexts[order - 1]
            at = np.minimum(np.searchsorted(context, key), len(context) - 1)
            out[open_] += np.where(context[at] == key, self.weights[order - 1][at], 0.0)
        out[open_] -= np.log(ALPHABET)
        return out

    def pack(self) -> list[bytes]:
        return [a.tobytes() for part in (self.grams, self.logs, self.contexts, self.weights) for a in part]

    @staticmethod
    def unpack(parts: list[bytes]) -> Model:
        kinds = [np.uint64, np.float64, np.uint64, np.float64]
        split = [parts[k * ORDER : (k + 1) * ORDER] for k in range(4)]
        return Model(*[[np.frombuffer(b, kind) for b in own] for own, kind in zip(split, kinds)])


def entropies(texts: pa.Array, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text in each model, and the characters (ends of words included)."""
    words, first = flat_words(texts, lower=False)
    coded = words.dictionary_encode()
    grams, count = _grams(coded.dictionary)
    distinct, at = np.unique(grams, return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(count)))
    occurring = coded.indices.to_numpy()
    chars = _between(count[occurring], first)
    sums = []
    for model in models:
        by_word = _between(model.score(distinct)[at], ends)
        sums.append(_between(by_word[occurring], first))
    return -np.stack(sums, 1) / np.maximum(chars, 1)[:, None], chars


def _between(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each run; each is summed on its own, so it does not depend on its neighbours."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


# --- learning -------------------------------------------------------------------------------


@dataclass
class Identifier:
    """Models by language (in code point order), and what calibration found."""

    languages: list[str]
    models: list[Model]
    usual: np.ndarray
    slope: float
    offset: float
    # Rejected are texts above usual + times * sqrt(between + noise / characters) + 1 / sqrt(characters).
    times: float = np.inf
    between: float = 0.0
    noise: float = 0.0

    def allowed(self, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The largest cross-entropy with which a text of so many characters is taken for its best language."""
        if np.isinf(self.times):
            return np.full(len(best), np.inf)
        chars = np.maximum(chars, 1)
        return self.usual[best] + self.times * np.sqrt(self.between + self.noise / chars) + 1 / np.sqrt(chars)


def _sample(docs: DataFrame, most_docs: int, most_chars: int) -> DataFrame:
    """lang, text, held (for calibration): the labelled documents of least hash, within the bounds of each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learns(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    long_ = F.length("text") > most_chars // 10
    by = W.partitionBy("lang").orderBy("_long", "_hash")
    ranked = known.select("lang", "text", long_.alias("_long"), F.xxhash64("doc_id", "text").alias("_hash")).withColumn("_rank", F.row_number().over(by))
    few = ranked.filter(F.col("_rank") <= most_docs).withColumn("_chars", F.sum(F.length("text")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    kept = few.filter((F.col("_chars") <= most_chars) | (F.col("_rank") == 1))
    return kept.select("lang", "text", ((F.col("_rank") % 4 == 0) & (F.col("_rank") > 1)).alias("held"), "_hash")


def _long_held(docs: DataFrame, sample: DataFrame, most_chars: int, long_held: int) -> DataFrame:
    """lang, text: of each language's long documents those of greatest hash, without any that teaches."""
    known = docs.filter(F.col("lang").isNotNull() & learns(F.col("doc_id")) & (F.length("text") > most_chars // 10) & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("_hash").desc()))
    last = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("_hash")).withColumn("_rank", rank).filter(F.col("_rank") <= long_held)
    return last.join(sample.select("_hash"), "_hash", "left_anti").select("lang", "text")


def fit(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS, long_held: int = 0) -> Identifier:
    """Learn from (doc_id, text, lang): only rows with text, a language, and a doc_id that is not held out.

    Per language at most ``most_docs`` documents of together ``most_chars`` characters, chosen by hash, every
    fourth of them for calibration; a language's first is taken however long. Up to ``long_held`` long documents
    more of each calibrate the rejection alone. Models travel through the driver: their size is bounded by the sample's.
    """
    sample = materialize(_sample(docs, most_docs, most_chars), "languages")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        words, _ = flat_words(pa.array(frame["text"]), lower=False)
        grams, _ = _grams(words)
        key, number = np.unique(grams, return_counts=True)
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "model": [Model.learn(key, number).pack()]})

    rows = sorted(sample.filter("not held").groupBy("lang").applyInPandas(learn, "lang string, model array<binary>").collect())
    languages, models = [r["lang"] for r in rows], [Model.unpack([bytes(b) for b in r["model"]]) for r in rows]
    found = Identifier(languages, models, np.zeros(len(rows)), 1.0, 0.0)

    def told(texts: DataFrame) -> pd.DataFrame:
        scored = _scored(texts.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang"), found, ["lang"]).collect()
        return pd.DataFrame([r.asDict() for r in scored], columns=["lang", "best", "entropy", "margin", "chars"])

    if len(rows):
        held = told(sample.filter("held"))
        _calibrate(found, held)
        _bound(found, pd.concat([held, told(_long_held(docs, sample, most_chars, long_held))]) if long_held else held)
    return found


def _bound(found: Identifier, held: pd.DataFrame) -> None:
    """Usual entropy per language, and the spread of all about it: between documents, and noise that falls with length."""
    names = np.array([*found.languages, None], object)
    own = held[(held["chars"] > 0) & (held["lang"].to_numpy() == names[held["best"].to_numpy(int)])].astype({"best": int})
    if len(own) < 5:
        return
    found.usual[:] = own["entropy"].mean()
    spread = []
    for i, rows in own.groupby("best"):
        if len(rows) >= 5:
            found.usual[i] = rows["entropy"].mean()
            spread.append(rows)
    # Languages with few held documents take the usual entropy, and the spread about it, of all.
    own = pd.concat(spread) if len(spread) == own["best"].nunique() else own
    over, chars = own["entropy"].to_numpy() - found.usual[own["best"]], own["chars"].to_numpy(float)
    # The longer half has least noise: what it shows is the spread between documents, which no length takes away.
    found.between = float((over[chars >= np.median(chars)] ** 2).mean())
    found.noise = float((over**2 * chars).mean())
    scale = np.sqrt(found.between + found.noise / chars)
    found.times = HEADROOM * max(DEVIATIONS, float((over / np.maximum(scale, 1e-12)).max()))


def _calibrate(found: Identifier, held: pd.DataFrame) -> None:
    """Slope and offset of the logistic curve from margin to score."""
    held = held[held["chars"] > 0]
    x = (held["margin"] * np.sqrt(held["chars"])).to_numpy(float)
    y = (held["lang"].to_numpy() == np.array([*found.languages, None], object)[held["best"].to_numpy(int)]).astype(float)
    if not len(x):
        return
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        # A weak pull to slope 1 keeps the fit finite when every choice was right.
        g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    found.slope, found.offset = float(a), float(b)


# --- use ------------------------------------------------------------------------------------


def _best(texts: pa.Array, found: Identifier) -> tuple[np.ndarray, ...]:
    """(best model, its entropy, margin to the next, characters); characters are 0 where no letter is."""
    entropy, chars = entropies(texts, found.models)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best = entropy.argmin(1)
    least = entropy[np.arange(len(best)), best]
    others = entropy.copy()
    others[np.arange(len(best)), best] = np.log(ALPHABET)
    return best, least, np.maximum(others.min(1) - least, 0), np.where(letters, chars, 0)


def _scored(docs: DataFrame, found: Identifier, kept: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=BLOCK_BYTES):
                best, entropy, margin, chars = _best(part.column("text"), found)
                own = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(best, pa.int32()), pa.array(entropy), pa.array(margin), pa.array(chars, pa.int64())], names=[*kept, "best", "entropy", "margin", "chars"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{schema}, best int, entropy double, margin double, chars long")


def _named(found: Identifier) -> Column:
    names = F.array(*[F.lit(x) for x in found.languages])
    return F.when(F.col("chars") == 0, UNKNOWN).otherwise(F.get(names, F.col("best")))


def _surety(found: Identifier) -> Column:
    x = F.lit(found.slope) * F.col("margin") * F.sqrt("chars") + F.lit(found.offset)
    return F.when(F.col("chars") == 0, 0.0).otherwise(1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0)))))


def identify(docs: DataFrame, found: Identifier | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its whole text.

    lang_pred is ``und`` (score 0) for a null text or one without a letter; ties go to the first language by code
    point. A null doc_id is held out. If nothing is learned every text is ``und``. Repeated rows get equal answers;
    an empty table gives none; other columns are left out.
    """
    found = found or fit(docs)
    held_out = ~learns(F.col("doc_id"))
    if not found.models:
        return docs.select("doc_id", held_out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    scored = _scored(docs.select(F.col("doc_id").cast("long"), "text"), found, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), _named(found).alias("lang_pred"), _surety(found).alias("score"))


def keep_identified(docs: DataFrame, found: Identifier | None = None) -> DataFrame:
    """The documents whose language is found, with their columns: those rejected go.

    Rejected: a null text, one without a letter, and one whose cross-entropy exceeds its language's usual one by more
    than documents differ and its length explains. If nothing is learned nothing is rejected. Empty table: no rows.
    """
    found = found or fit(docs, long_held=LONG_HELD)
    if not found.models:
        return docs
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            for part in chunks(pa.RecordBatch.from_arrays(batch.columns, names=[str(i) for i in range(len(columns))]), str(at), BLOCK_BYTES):
                best, entropy, _, chars = _best(part.column(at), found)
                fine = (chars > 0) & (entropy <= found.allowed(best, chars))
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(fine)).columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
