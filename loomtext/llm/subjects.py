"""Subject areas of documents: averaged word and subword embeddings with logistic outputs.

A text is the average of its word vectors; a word is its own vector plus the average of
its character n-gram vectors; each area has an independent logistic output. Training is
synchronous: every round each partition sums the gradient over its labelled documents, the
partitions' sums are added up slice by slice on the executors, and the driver takes one step
with the total, whose size depends on the model only. First whole documents are the examples; then their sentences, each with the area among its document's labels that
the first model finds in it, which tells apart the areas of mixed documents. As the
output is linear in the average, a trained model is a table of area scores for each word,
which scores every sentence of every document in one pass; an area counts for a document
by its share of the sentences, and a text where no area has enough gets its best one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import discard, durable, spread
from .canonical import canonical_texts, form_tables
from .codepoints import CHUNK_CHARS, LIMIT, VISIBLE, char_tables, chunked, explode, mix, slots, words_of

WORD_SLOTS, GRAM_SLOTS, DIM = 1 << 15, 1 << 15, 16
GRAMS = (3, 4, 5)
#: Bounds on the labelled texts used for training: of each stratum (language), of all, and on their characters.
PER_STRATUM, MAX_LABELLED, MAX_CHARS = 2000, 8000, 64_000_000
#: Probability below which a sentence counts as one without an area, and above which as one with it.
NO_AREA_BELOW, SOME_AREA_ABOVE = 0.02, 0.15
#: Rounds and step size, over documents and then over sentences.
DOCUMENT_ROUNDS, DOCUMENT_RATE, SENTENCE_ROUNDS, SENTENCE_RATE = 20, 0.1, 30, 0.05
#: Partitions of the labelled sample, hence sums of gradients that a round adds up, each in so many slices.
TRAIN_PARTITIONS, SLICES = 8, 4


@dataclass
class Model:
    """Parameters; ``areas`` names the outputs."""

    areas: list[str]
    word: np.ndarray
    gram: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.word, self.gram, self.out, self.bias]


def new_model(areas: list[str]) -> Model:
    r = np.random.default_rng(7)
    draw = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    return Model(areas, draw(WORD_SLOTS, DIM), draw(GRAM_SLOTS, DIM), draw(DIM, len(areas)), np.full(len(areas), -2.0, np.float32))


@dataclass(frozen=True)
class Vocabulary:
    """Words of a chunk: the distinct one of each occurrence, its slot and its n-grams."""

    each: np.ndarray
    slot: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray


def _vocabulary(cps: np.ndarray, words, tables) -> Vocabulary:
    """Slots of the distinct words and their n-grams, edges included."""
    hashes, first_seen, each = np.unique(words.hashes, return_index=True, return_inverse=True)
    begin, end = words.first[first_seen], words.last[first_seen]
    size = end - begin + 2
    starts = np.cumsum(size) - size
    chars = np.full(int(size.sum()), 1, np.uint64)
    inner = np.ones(chars.size, bool)
    inner[starts] = inner[starts + size - 1] = False
    at = np.arange(inner.sum()) + np.repeat(begin - (np.cumsum(size - 2) - (size - 2)), size - 2)
    chars[inner] = tables.lower[slots(cps[at])]
    left = np.repeat(starts + size, size) - np.arange(chars.size)
    word = np.repeat(np.arange(size.size), size)
    rolling, found, owner = np.zeros(chars.size, np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        step = np.zeros(chars.size, np.uint64)
        step[: chars.size - n + 1] = chars[n - 1 :]
        rolling = mix(rolling * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(1))
        if n in GRAMS:
            ok = left >= n
            found.append(rolling[ok] % np.uint64(GRAM_SLOTS))
            owner.append(word[ok])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return Vocabulary(each, (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), found[order].astype(np.int64), np.searchsorted(owner[order], np.arange(size.size)))


def _word_vectors(v: Vocabulary, word: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A word's own vector and the mean of its n-grams'; every word has one, as its edges count."""
    many = np.diff(np.append(v.gram_starts, v.grams.size)).astype(np.float32)
    return word[v.slot] + np.add.reduceat(gram[v.grams], v.gram_starts) / many[:, None]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(v: Vocabulary, unit: np.ndarray) -> dict[str, np.ndarray]:
    """What a gradient needs of some examples, indexed once and used in every round.

    ``unit`` is the example that each word is in, ascending, -1 for none. Distinct words of
    each example with their share of its words, by example and (``by_word``) by word; the
    words' slots and n-grams, and (``by_slot``, ``by_gram``) the orders that bring equal slots
    and n-grams together.
    """
    used, each = np.unique(v.each[unit >= 0], return_inverse=True)
    unit = unit[unit >= 0]
    many = np.diff(np.append(v.gram_starts, v.grams.size))[used]
    ends = np.zeros(used.size + 1, np.int64)
    np.cumsum(many, out=ends[1:])
    grams = v.grams[np.arange(ends[-1]) + np.repeat(v.gram_starts[used] - ends[:-1], many)]
    slot = v.slot[used]
    pair, count = np.unique(unit.astype(np.int64) * max(used.size, 1) + each, return_counts=True)
    doc, word = pair // max(used.size, 1), pair % max(used.size, 1)
    f = {"doc": doc, "word": word, "by_word": np.argsort(word, kind="stable"), "slot": slot, "by_slot": np.argsort(slot, kind="stable"), "grams": grams, "gram_ends": ends, "by_gram": np.argsort(grams, kind="stable")}
    f["gram_word"] = np.repeat(np.arange(used.size), many)[f["by_gram"]]
    return {k: x.astype(np.int32) for k, x in f.items()} | {"share": (count / np.bincount(unit)[doc]).astype(np.float32)}


def document_examples(texts: list[str], y: np.ndarray, tables) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """Whole texts with their labels."""
    cps, starts = explode(texts)
    w = words_of(cps, starts, tables)
    if not w.hashes.size:
        return None
    return features(_vocabulary(cps, w, tables), np.repeat(np.arange(len(texts)), np.diff(w.starts))), y


def sentence_examples(texts: list[str], y: np.ndarray, m: Model, tables) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """Sentences with the area of their text that the model finds in them.

    Left out are sentences whose likeliest area is not a label of the text, and unclear ones.
    """
    cps, starts = explode(texts)
    w = words_of(cps, starts, tables)
    if not w.hashes.size:
        return None
    v = _vocabulary(cps, w, tables)
    z, text, bounds = _sentences(cps, starts, w, v, area_table(m))
    p = _sigmoid(z)
    best = p.argmax(axis=1)
    own = y[text, best] > 0
    clear = p.max(axis=1)
    kept = (clear < NO_AREA_BELOW) | (clear > SOME_AREA_ABOVE) & own
    if not kept.any():
        return None
    target = np.zeros((int(kept.sum()), y.shape[1]), np.float32)
    some = clear[kept] > SOME_AREA_ABOVE
    target[np.flatnonzero(some), best[kept][some]] = 1
    unit = np.where(kept, np.cumsum(kept) - 1, -1)
    return features(v, np.repeat(unit, np.diff(bounds))), target


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each begins."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], first


Touched = tuple[np.ndarray, np.ndarray]


def residuals(f: dict[str, np.ndarray], y: np.ndarray, m: Model) -> tuple[Touched, Touched, np.ndarray, np.ndarray, float]:
    """Sums over some texts: touched slots of both embeddings with the errors of each area that
    reach them, the gradients of the outputs and the bias, and the loss.

    A slot's gradient is its errors times the outputs, so errors are summed first. Every word
    has an n-gram, as its edges count.
    """
    many = np.diff(f["gram_ends"])[:, None].astype(np.float32)
    vectors = m.word[f["slot"]] + np.add.reduceat(m.gram[f["grams"]], f["gram_ends"][:-1]) / many
    docs, begins = _groups(f["doc"])
    x = np.add.reduceat(vectors[f["word"]] * f["share"][:, None], begins)
    y = y[docs]
    p = _sigmoid(x @ m.out + m.bias)
    loss = -float((y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).sum())
    g = (p - y).astype(np.float32)
    back = np.repeat(g, np.diff(np.append(begins, f["doc"].size)), axis=0) * f["share"][:, None]
    e = np.add.reduceat(back[f["by_word"]], _groups(f["word"][f["by_word"]])[1])
    rows, first = _groups(f["slot"][f["by_slot"]])
    word = (rows, np.add.reduceat(e[f["by_slot"]], first))
    rows, first = _groups(f["grams"][f["by_gram"]])
    gram = (rows, np.add.reduceat((e / many)[f["gram_word"]], first))
    return word, gram, x.T @ g, g.sum(axis=0), loss


def gradient(f: dict[str, np.ndarray], y: np.ndarray, m: Model) -> tuple[list[Touched], np.ndarray, np.ndarray, float]:
    """Touched rows of both embeddings with their gradients, those of the outputs and the bias, and the loss."""
    word, gram, out, bias, loss = residuals(f, y, m)
    return [(word[0], word[1] @ m.out.T), (gram[0], gram[1] @ m.out.T)], out, bias, loss


class Total:
    """Sum of the residuals of many examples: a row for each word and n-gram slot, then the outputs and the bias."""

    def __init__(self, areas: int):
        self.sums = np.zeros((WORD_SLOTS + GRAM_SLOTS + DIM + 1, areas), np.float32)

    def add(self, word: Touched, gram: Touched, out: np.ndarray, bias: np.ndarray) -> None:
        self.sums[word[0]] += word[1]
        self.sums[WORD_SLOTS + gram[0]] += gram[1]
        self.sums[WORD_SLOTS + GRAM_SLOTS : -1] += out
        self.sums[-1] += bias

    def slices(self) -> pa.RecordBatch:
        """A row for each slice: its number, and its sums, each row to 11 bits of its largest one."""
        parts = np.array_split(self.sums, SLICES)
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([_shorten(x) for x in parts], pa.binary())], ["slice", "sums"])

    def gradients(self, m: Model) -> list[np.ndarray]:
        word, gram, out, bias = np.split(self.sums, [WORD_SLOTS, WORD_SLOTS + GRAM_SLOTS, self.sums.shape[0] - 1])
        return [word @ m.out.T, gram @ m.out.T, out, bias[0]]


def _shorten(x: np.ndarray) -> bytes:
    """Rows as half floats of their largest value, zero rows left out."""
    some = np.flatnonzero(x.any(axis=1)).astype(np.int32)
    scale = np.abs(x[some]).max(axis=1, initial=0).astype(np.float32)
    return np.int32(some.size).tobytes() + some.tobytes() + scale.tobytes() + (x[some] / scale[:, None]).astype(np.float16).tobytes()


def _add_shortened(x: np.ndarray, data: bytes) -> None:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    rows, scale = np.frombuffer(data, np.int32, n, 4), np.frombuffer(data, np.float32, n, 4 + 4 * n)
    x[rows] += np.frombuffer(data, np.float16, n * x.shape[1], 4 + 8 * n).reshape(n, -1) * scale[:, None]


class Adam:
    """One synchronous step after another on the driver."""

    def __init__(self, m: Model, rate: float):
        self.rate, self.t = rate, 0
        self.mean = [np.zeros_like(a) for a in m.arrays()]
        self.var = [np.zeros_like(a) for a in m.arrays()]

    def step(self, m: Model, grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, mean, var in zip(m.arrays(), grads, self.mean, self.var):
            mean += 0.1 * (g - mean)
            var += 0.01 * (g * g - var)
            a -= self.rate * (mean / (1 - 0.9**self.t)) / (np.sqrt(var / (1 - 0.99**self.t)) + 1e-8)


# Characters that end a sentence, and those that may close it.
_STOPS, _CLOSERS = ".!?…", "\"'”’»)]“"


_STOP, _CLOSER, _BLANK, _DIGIT = 1, 2, 4, 8


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """What each character means for sentences, by code point."""
    out = np.zeros(LIMIT + 2, np.uint8)
    for chars, bit in ((_STOPS, _STOP), (_CLOSERS, _CLOSER), (" \t\n\r", _BLANK), ("0123456789", _DIGIT)):
        out[[ord(c) for c in chars]] |= bit
    return out


def sentence_of(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the sentence that each character is in, counted through the chunk.

    A sentence ends with a line or text, or with a stop that only closing quotes separate
    from a blank. A full stop after one to three digits marks an ordinal and ends nothing.
    """
    n = cps.size
    mark = _marks()[slots(cps)]
    stop = (mark & _STOP) > 0
    digit = (mark & _DIGIT) > 0
    run = digit.copy()
    for _ in range(3):
        run[1:] = run[:-1] & digit[1:]
        run[:1] = False
    stop[1:] &= ~((cps[1:] == 0x2E) & digit[:-1] & ~run[:-1])
    closer = (mark & _CLOSER) > 0
    blank = (mark & _BLANK) > 0
    ended = stop.copy()
    for _ in range(2):
        ended[1:] |= ended[:-1] & closer[1:]
    breaks = np.zeros(n + 1, np.int64)
    breaks[1:n] = (ended[:-1] & blank[1:]) | (cps[:-1] == 0x0A)
    breaks[starts[1:-1]] = 1
    return np.cumsum(breaks)[:n]


def area_table(m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each word slot and n-gram slot adds to the areas' scores, and the bias."""
    return m.word @ m.out, m.gram @ m.out, m.bias


def _sentences(cps, starts, w, v: Vocabulary, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Area logits of each sentence that has words, the text each is in, and their bounds in words."""
    scores = _word_vectors(v, table[0], table[1])
    sentence = sentence_of(cps, starts)[w.first]
    bounds = np.append(np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])), sentence.size)
    z = np.add.reduceat(scores[v.each], bounds[:-1]) / np.diff(bounds).astype(np.float32)[:, None] + table[2]
    return z, np.searchsorted(w.starts, bounds[:-1], "right") - 1, bounds


def sentence_scores(texts: list[str | None], table, tables) -> tuple[np.ndarray, np.ndarray]:
    """Area logits of each sentence that has words, and the text each is in."""
    cps, starts = explode(texts)
    w = words_of(cps, starts, tables)
    if not w.hashes.size:
        return np.zeros((0, table[2].size), np.float32), np.zeros(0, np.int64)
    return _sentences(cps, starts, w, _vocabulary(cps, w, tables), table)[:2]


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes | pa.Buffer) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as x:
        return dict(x)


def _sample(docs: DataFrame, labels: DataFrame, stratum: str | None, per_stratum: int, at_most: int, most_chars: int) -> DataFrame:
    """Labelled texts, at most about ``per_stratum`` of each stratum, chosen by the hash of their key.

    Whole texts are taken in the order of the hash up to ``at_most`` of them and ``most_chars`` in all.
    """
    known = docs.select("id", *([F.lower(F.substring(F.trim(stratum), 1, 2)).alias("s")] if stratum else [F.lit(None).cast("string").alias("s")])).where("id is not null")
    keyed = known.join(labels.select("id"), "id", "left_semi").select("id", F.coalesce("s", F.lit("")).alias("s"))
    share = keyed.groupBy("s").count().select("s", (F.lit(per_stratum) / F.col("count")).alias("share"))
    kept = keyed.join(share, "s").where(F.pmod(F.xxhash64("id", F.lit("pick")), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    first = kept.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(at_most)
    sizes = docs.join(F.broadcast(first), "id").groupBy("id").agg(F.max(F.length("text")).cast("long").alias("chars"))
    # at most ``at_most`` rows
    running = F.sum("chars").over(Window.orderBy(F.xxhash64("id"), "id"))
    chosen = durable(sizes.withColumn("running", running).where(F.col("running") <= most_chars).select("id"), "chosen")
    texts = docs.select("id", "text").join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"))
    return texts.join(labels.join(F.broadcast(chosen), "id"), "id")


def _examples(sample: DataFrame, areas: list[str], model: Model | None) -> DataFrame:
    """Indexed examples of each partition: documents, or with a model their sentences."""
    context = sample.sparkSession.sparkContext
    tables = context.broadcast((form_tables(), char_tables(), model))
    number = {a: i for i, a in enumerate(areas)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, chars, m = tables.value
        for b in batches:
            texts = canonical_texts(b.column(0).to_pylist(), forms)[0]
            labels = b.column(1).to_pylist()
            for lo, hi in chunked(texts, 2 * CHUNK_CHARS):
                y = np.zeros((hi - lo, len(areas)), np.float32)
                for i, own in enumerate(labels[lo:hi]):
                    y[i, [number[s] for s in own]] = 1
                found = sentence_examples(texts[lo:hi], y, m, chars) if m else document_examples(texts[lo:hi], y, chars)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([_pack(found[0] | {"y": found[1]})], pa.binary()), pa.array([len(found[1])], pa.int64())], ["f", "n"])

    out = durable(sample.mapInArrow(index, "f binary, n long"), "examples")
    tables.destroy()
    return out


def _round(examples: DataFrame, model: Model) -> Total:
    """The residuals of all examples: a sum for each partition, then one for each slice, on the executors."""
    areas = len(model.areas)
    sent = examples.sparkSession.sparkContext.broadcast(model)

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Total(areas)
        for b in batches:
            for data in b.column(0):
                f = _unpack(data.as_buffer())
                own.add(*residuals(f, f.pop("y"), sent.value)[:4])
        yield own.slices()

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in parts:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i not in held:
                    held[i] = np.zeros_like(np.array_split(Total(areas).sums, SLICES)[i])
                _add_shortened(held[i], data)
        for i, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_shorten(x)], pa.binary())], ["slice", "sums"])

    sums = examples.select("f").mapInArrow(push, "slice int, sums binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, sums binary")
    total = Total(areas)
    parts = np.array_split(total.sums, SLICES)
    for row in sums.collect():  # SLICES rows
        _add_shortened(parts[row["slice"]], row["sums"])
    sent.destroy()
    return total


def _fit(examples: DataFrame, model: Model, rounds: int, rate: float) -> None:
    """Synchronous steps; a round brings the driver one sum of all gradients, sized by the model alone."""
    n = examples.agg(F.sum("n")).first()[0]
    if not n:
        return
    adam = Adam(model, rate)
    for _ in range(rounds):
        adam.step(model, [g / n for g in _round(examples, model).gradients(model)])


def train(docs: DataFrame, labels: DataFrame, areas: list[str], stratum: str | None = None, per_stratum: int = PER_STRATUM, at_most: int = MAX_LABELLED, most_chars: int = MAX_CHARS) -> Model:
    """Fit a model on a bounded sample of labelled texts.

    ``docs`` has ``id``, ``text`` and the optional ``stratum`` (its first two letters count),
    ``labels`` has ``id`` and ``subject``; labels are compared in lower case without blanks
    around, and repeated, null and unknown ones are left out. The sample is bounded in texts and
    characters; gradients are summed over ``TRAIN_PARTITIONS`` partitions and then on the
    executors, so what reaches the driver grows neither with the texts nor with their number.
    """
    model = new_model(areas)
    clean = labels.select("id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(areas) & F.col("id").isNotNull())
    known = clean.groupBy("id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    sample = _sample(docs.where(F.col("text").rlike(VISIBLE)), known, stratum, per_stratum, at_most, most_chars)
    sample = durable(sample.select("text", "subjects").repartition(TRAIN_PARTITIONS, "text"), "sample")
    for start, rounds, rate in ((None, DOCUMENT_ROUNDS, DOCUMENT_RATE), (model, SENTENCE_ROUNDS, SENTENCE_RATE)):
        examples = _examples(sample, areas, start)
        _fit(examples, model, rounds, rate)
        discard(examples)
    discard(sample)
    return model


def area_shares(df: DataFrame, model: Model, least: float = 0.18) -> DataFrame:
    """The areas of each row of ``df``: its columns other than ``text``, then ``subject`` and ``share``.

    ``share`` is the part of the row's sentences that belong to the area, at least
    ``least``. A sentence belongs to its likeliest area if that is likelier than not. Where
    no area has that many, the row has the one of the largest share, with equal shares (all
    zero, say) the one of the largest mean logit; ``share`` is then below ``least``. A text
    with content but no words has the area that the model expects of any text. Only null and
    blank texts, and those blank in canonical form, have no row. Every row of ``df`` is
    scored by itself, in one pass without a shuffle.
    """
    context = df.sparkSession.sparkContext
    tables = context.broadcast((form_tables(), char_tables(), area_table(model)))
    names = np.array(model.areas, dtype=object)
    others = [c for c in df.columns if c != "text"]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, chars, table = tables.value
        for b in batches:
            texts = canonical_texts(b.column(len(others)).to_pylist(), forms)[0]
            for lo, hi in chunked(texts):
                z, text = sentence_scores(texts[lo:hi], table, chars)
                n = np.bincount(text, minlength=hi - lo)
                best = z.argmax(axis=1)
                sure = z[np.arange(best.size), best] > 0
                share, mean = np.zeros((hi - lo, names.size)), np.zeros((hi - lo, names.size))
                np.add.at(share, (text[sure], best[sure]), 1)
                np.add.at(mean, text, z)
                share /= np.maximum(n, 1)[:, None]
                mean = np.where(n[:, None] > 0, mean / np.maximum(n, 1)[:, None], table[2])
                kept = share >= least
                none = np.flatnonzero(~kept.any(axis=1) & np.array([bool(s) and not s.isspace() for s in texts[lo:hi]]))
                top = share[none] == share[none].max(axis=1, keepdims=True)
                kept[none, np.where(top, mean[none], -np.inf).argmax(axis=1)] = True
                row, area = np.nonzero(kept)
                keys = [b.column(j).take(pa.array(row + lo)) for j in range(len(others))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(names[area].tolist(), pa.string()), pa.array(share[row, area])], [f.name for f in schema])

    return spread(df.select(*others, F.col("text").cast("string").alias("text")).where(F.col("text").rlike(VISIBLE))).mapInArrow(run, schema)


def subject_areas(docs: DataFrame, pages: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``origin``, ``rec_id``, ``subject`` and ``share`` for documents and encyclopedia pages.

    Of a page with several revisions the latest one with content counts. Repeated rows and
    keys give one row for each area.
    """
    names = [r[0] for r in areas.select(F.lower(F.trim("subject")).alias("subject")).where("subject is not null").distinct().orderBy("subject").limit(10_001).collect()]
    if not names:
        return docs.sparkSession.createDataFrame([], "origin string, rec_id string, subject string, share double")
    if len(names) > 10_000:
        raise ValueError("an output for each area: at most 10,000 areas")
    stratum = "lang" if "lang" in docs.columns else None
    keyed = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), *([stratum] if stratum else []))
    model = train(keyed, labels.select(F.col("doc_id").alias("id"), "subject"), names, stratum)
    mine = docs.select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("rec_id"), "text").where(F.col("rec_id").isNotNull() & F.col("text").rlike(VISIBLE))
    own = area_shares(mine, model).groupBy("origin", "rec_id", "subject").agg(F.max("share").alias("share"))
    rows = pages.select(F.col("id").cast("string").alias("rec_id"), F.struct("revised_at", "loaded_at", F.xxhash64("text").alias("t")).alias("v"), "text").where(F.col("rec_id").isNotNull() & F.col("text").rlike(VISIBLE))
    latest = rows.groupBy("rec_id").agg(F.max("v").alias("last"))
    scored = area_shares(rows, model).join(latest, "rec_id").where("v <=> last").select(F.lit("wikipedia").alias("origin"), "rec_id", "subject", "share").distinct()
    return own.unionByName(scored)
