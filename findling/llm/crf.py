"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a label (a language); features of a word are hashed byte trigrams, its four-byte
prefix and suffix, and the word itself (a learned lexicon), ASCII letters lower-cased; transitions between
neighbours are learned. So code-switched text gets labels word by word; ``label_words`` returns them. The
forward-backward algorithm gives each word's marginals, and their mean over the words with letters is the
text's distribution: its largest share is the score and its label the prediction (of equal shares the first
label in order). Forward-backward runs on blocks of ``BLOCK`` words of all texts at a time: the product of a
block's potentials carries messages over it, so a text of any length is processed whole and exactly.

Training takes a bounded sample: up to ``SAMPLE`` texts for each label (by a hash of the id), a window of at most
``WINDOW`` characters of each, in sequences half of which are spliced from runs of several languages, as
labelled code-switching is not to be had. Weights follow the gradient of the conditional likelihood.

Texts that are null or have no letter are ``und`` with score 0. Rows with one id are judged one by one. Only
``text`` enters a prediction. Without any labelled text every prediction is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernel as K
from ._shared import Workspace

SAMPLE = 400
WINDOW = 1500
TABLE = 1 << 16
SEQUENCE = 64
RUN_WORDS = 12
EPOCHS = 24
RATE = 0.4
BLOCK = 32
UNKNOWN = "und"
#: The filter drops texts whose words are labelled less surely (mean of each word's largest marginal).
MIN_SURE = 0.5

_U = np.uint64
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts lower-cased with one space after each, and white space as spaces: no text touches another."""
    low = np.where(K.IS_SPACE[raw], np.uint8(32), K.LOWER[raw])
    return np.insert(low, at[1:], 32), at + np.arange(len(at))


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Table rows of the trigram around every byte, and of every word, its prefix and its suffix."""
    wide = np.concatenate(([32], raw, [32])).astype(_U)
    gram = K.mix(wide[:-2] << _U(16) | wide[1:-1] << _U(8) | wide[2:])
    spans = ((start, end), (start, np.minimum(start + 4, end)), (np.maximum(end - 4, start), end))
    rows = [((K.span_hash(raw, a, b) + _U((k + 1) * int(K.BASE) % (1 << 64))) >> _U(48)).astype(np.int64) for k, (a, b) in enumerate(spans)]
    return (gram >> _U(48)).astype(np.int64), rows


def _sum_words(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of rows start to end of each word; each sum depends on its own word alone."""
    if not len(start):
        return np.zeros((0, values.shape[1]), values.dtype)
    edge = np.stack((start, end), 1).ravel()
    return np.add.reduceat(np.concatenate((values, np.zeros((1, values.shape[1]), values.dtype))), edge, axis=0)[::2]


class Model:
    """Weights: ``tables`` (trigrams, words, prefixes, suffixes) by hash and label, transitions and first labels."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.tables = np.zeros((4, TABLE, n), np.float32)
        self.move = np.zeros((n, n))
        self.first = np.zeros(n)

    def scores(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        gram, rows = _hashed(raw, start, end)
        out = _sum_words(self.tables[0][gram], start, end).astype(np.float64)
        for table, row in zip(self.tables[1:], rows, strict=True):
            out += table[row]
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Label marginals of every word; ``first[i]:first[i + 1]`` are the words of text i."""
        n, k = scores.shape
        count = np.diff(first)
        docs = np.flatnonzero(count)
        if not n:
            return scores
        blocks = -(-count[docs] // BLOCK)
        top = np.concatenate(([0], np.cumsum(blocks)))
        total = int(top[-1])
        doc = np.repeat(np.arange(len(docs)), blocks)
        inside = np.arange(total) - top[doc]
        place = first[docs][doc] + inside * BLOCK
        size = np.minimum(BLOCK, count[docs][doc] - inside * BLOCK)
        index = place[:, None] + np.arange(BLOCK)
        real = np.arange(BLOCK) < size[:, None]
        emit = np.exp(scores - scores.max(1, keepdims=True))[np.where(real, index, 0)]
        move = np.exp(self.move - self.move.max())
        # A text's first word has no neighbour before it: its step is the first labels' weights.
        first_block = top[:-1]
        moves = real.copy()
        moves[first_block, 0] = False
        # The product of each block's potentials, from the state before it (in a text's first block: the state at its
        # first word) to the state at its end.
        product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t in range(BLOCK):
            step = (product @ move) * emit[:, t, None, :]
            step /= step.max((1, 2), keepdims=True)
            product = np.where(moves[:, t, None, None], step, product)
        # Messages into blocks, one rank of blocks of all texts at a time.
        before, after = np.empty((total, k)), np.ones((total, k))
        head = np.exp(self.first - self.first.max()) * emit[first_block, 0]
        before[first_block] = head / head.sum(1, keepdims=True)
        for r in range(1, int(blocks.max())):
            own = first_block[blocks > r] + r
            x = np.einsum("nk,nkj->nj", before[own - 1], product[own - 1])
            before[own] = x / x.sum(1, keepdims=True)
        for r in range(int(blocks.max()) - 2, -1, -1):
            own = first_block[blocks > r + 1] + r
            x = np.einsum("nkj,nj->nk", product[own + 1], after[own + 1])
            after[own] = x / x.sum(1, keepdims=True)
        forward = np.empty((total, BLOCK, k))
        x = before
        for t in range(BLOCK):
            step = (x @ move) * emit[:, t]
            step /= step.sum(1, keepdims=True)
            x = np.where(moves[:, t, None], step, x)
            forward[:, t] = x
        x = after
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= x
            step = (emit[:, t] * x) @ move.T
            step /= step.sum(1, keepdims=True)
            x = np.where(real[:, t, None], step, x)
        out = np.empty((n, k))
        out[index[real]] = forward[real]
        return out / out.sum(1, keepdims=True)

    def texts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all words, whether each has a letter (or a byte beyond ASCII), and the words' places."""
        low, at = _padded(raw, at)
        start, end, first = K.words(low, at)
        share = self.marginals(self.scores(low, start, end), first)
        flag = (_ASCII_LETTER[low] | (low >= 128)).astype(np.int64)[:, None]
        return share, _sum_words(flag, start, end)[:, 0] > 0, start - np.repeat(np.arange(len(at) - 1), np.diff(first)), first


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """Fits a model to (label, text) pairs."""
    samples = sorted(samples)
    labels = sorted({x for x, _ in samples})
    model = Model(labels)
    if not samples:
        return model
    raw, at = K.flatten(pa.array([x for _, x in samples], pa.string()))
    low, at = _padded(raw, at)
    start, end, first = K.words(low, at)
    label = np.repeat([labels.index(x) for x, _ in samples], np.diff(first))
    # Half of the sequences follow the texts; the others splice runs of words from all of them.
    rng = np.random.Generator(np.random.PCG64(7))
    runs = np.array_split(np.arange(len(start)), max(1, len(start) // RUN_WORDS))
    mixed = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    sequences = np.concatenate([np.arange(len(start)), mixed])
    sequences = sequences[: len(sequences) // SEQUENCE * SEQUENCE] if len(sequences) >= SEQUENCE else np.resize(sequences, SEQUENCE)
    sequences = sequences.reshape(-1, SEQUENCE)
    b, k = len(sequences), len(labels)
    truth = label[sequences]
    gram, rows = _hashed(low, start, end)
    size = end - start
    word_of_byte = np.repeat(np.arange(len(start)), size)
    gram = gram[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    gold = np.eye(k)[truth]
    change = {"t": np.full(model.tables.shape, 1e-2, np.float32), "m": np.full((k, k), 1e-2), "f": np.full(k, 1e-2)}
    for _ in range(epochs):
        word_scores = np.add.reduceat(model.tables[0][gram], np.cumsum(size) - size, axis=0).astype(float)
        for table, row in zip(model.tables[1:], rows, strict=True):
            word_scores += table[row]
        emit = np.exp(word_scores - word_scores.max(1, keepdims=True))[sequences]
        move, head = np.exp(model.move - model.move.max()), np.exp(model.first - model.first.max())
        ahead, back = np.empty((b, SEQUENCE, k)), np.ones((b, SEQUENCE, k))
        x = head * emit[:, 0]
        for t in range(SEQUENCE):
            x = x if t == 0 else (x @ move) * emit[:, t]
            x = x / x.sum(1, keepdims=True)
            ahead[:, t] = x
        x = np.ones((b, k))
        pair = np.zeros((k, k))
        for t in range(SEQUENCE - 2, -1, -1):
            y = emit[:, t + 1] * x
            both = ahead[:, t, :, None] * move * y[:, None, :]
            pair += (both / both.sum((1, 2), keepdims=True)).sum(0)
            x = y @ move.T
            x = x / x.sum(1, keepdims=True)
            back[:, t] = x
        share = ahead * back
        share /= share.sum(2, keepdims=True)
        slope = np.zeros((len(start), k))
        np.add.at(slope, sequences.ravel(), (gold - share).reshape(-1, k))
        slope /= b * SEQUENCE / 1000  # so that the rate doesn't depend on the sample's size
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        table_slope = np.stack(
            [np.stack([np.bincount(row, slope[of, c], TABLE) for c in range(k)], 1) for row, of in ((gram, word_of_byte), *((r, slice(None)) for r in rows))]
        ).astype(np.float32)
        for what, name, g in ((model.tables, "t", table_slope), (model.move, "m", (seen - pair) / b), (model.first, "f", (gold[:, 0] - share[:, 0]).mean(0))):
            change[name] += g * g
            what += (RATE * g / np.sqrt(change[name])).astype(what.dtype)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> Model:
    """Trains on a bounded sample of the labelled texts outside the held-out fold."""
    known = docs.select("doc_id", "text", F.col("lang").alias("label")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).toLocalIterator()}  # one row a label
    rank = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    rows: list[tuple[str, str]] = []
    chosen = None
    for label, n in sorted(size.items()):
        limit = min(1_000_000, int(2_000_000 * sample / n) + 1)  # twice as many as needed, in expectation
        part = (F.col("label") == label) & (rank < limit)
        chosen = part if chosen is None else chosen | part
    if chosen is None:
        return Model([])
    place = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.lit(1), F.length("text") - window).cast("long")).cast("int")
    cut = known.where(chosen).select("label", "doc_id", rank.alias("rank"), F.substring("text", place, F.lit(window)).alias("part"))
    taken: dict[str, int] = {}
    for r in cut.orderBy("rank", "doc_id", "part").limit(3 * sample * len(size)).toLocalIterator():
        if taken.get(r["label"], 0) < sample:
            taken[r["label"]] = taken.get(r["label"], 0) + 1
            rows.append((r["label"], r["part"]))
    model = train(rows)
    K.give_back()
    return model


def _judge(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Prediction and score of each text, and how surely its words are labelled."""
    docs = len(at) - 1
    if not model.labels:
        return [UNKNOWN] * docs, np.zeros(docs), np.zeros(docs)
    share, lettered, _, first = model.texts(raw, at)
    of = np.repeat(np.arange(docs), np.diff(first))[lettered]
    total = np.stack([np.bincount(of, share[lettered, c], docs) for c in range(len(model.labels))], 1)
    number = np.bincount(of, minlength=docs)
    sure = np.bincount(of, share[lettered].max(1), docs) / np.maximum(number, 1)
    mean = total / np.maximum(number, 1)[:, None]
    best = np.round(mean, 9).argmax(1)
    has = np.diff(np.concatenate(([0], np.cumsum(_ASCII_LETTER[raw])))[at]) > 0
    for i in np.flatnonzero(~has).tolist():  # no ASCII letter: other alphabets, or none at all
        has[i] = _LETTER.search(raw[at[i] : at[i + 1]].tobytes().decode(errors="ignore")) is not None
    has &= number > 0
    labels = [model.labels[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
    return labels, np.where(has, np.clip(mean[np.arange(docs), best], 0, 1), 0.0), np.where(has, sure, 0.0)


def _predict(sent):
    def run(batches):
        model = sent.value
        for batch, raw, at in K.steps(batches):
            label, score, _ = _judge(model, raw, at)
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_report(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score)``, one for each row of ``docs``."""
    Workspace(docs.sparkSession, "crf")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))  # TABLE * 16 bytes for each label
    kind = "doc_id long, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(model), kind)


def _keep(sent):
    def run(batches):
        model = sent.value
        for batch, raw, at in K.steps(batches):
            label, _, sure = _judge(model, raw, at)
            yield batch.filter(pa.array([x != UNKNOWN and s >= MIN_SURE for x, s in zip(label, sure.tolist(), strict=True)]))

    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose words are labelled surely, in one language or in several by turns; columns as they are."""
    Workspace(docs.sparkSession, "crf")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")))
    return docs.mapInArrow(_keep(model), docs.schema)


def _label(sent):
    def run(batches):
        model = sent.value
        for batch, raw, at in K.steps(batches):
            share, _, _, first = model.texts(raw, at)
            best = share.argmax(1) if len(share) else np.zeros(0, np.int64)
            labels = pa.array([model.labels[i] for i in best.tolist()], pa.string())
            yield batch.append_column("word_labels", pa.ListArray.from_arrays(pa.array(first, pa.int32()), labels))

    return run


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``word_labels``, the most likely language of each word of ``text`` in order."""
    Workspace(docs.sparkSession, "crf")
    return docs.mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(model)), T.StructType([*docs.schema.fields, T.StructField("word_labels", T.ArrayType(T.StringType()))]))
