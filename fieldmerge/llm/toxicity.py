"""Toxicity by a counterfactual-regularised classifier.

A text is the set of its words and of the first 4, 5 and 6 letters of longer ones, hashed; a logistic model adds their weights.
In training, every labelled text that names a group is paired with a copy in which each identity term is swapped for another
of its family, and the squared difference of the two logits is penalised. Weights that only identity terms carry cancel nothing
else, so they shrink, and a neutral mention of a group no longer raises the score; what words beside it do to the score stays.

Families of identity terms are a table (family, term), FAMILIES where none is given. Features are counted and chosen by Spark
over the labelled sample; the driver sees the chosen ones only, and how often each stands in the sample's texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored
from fieldmerge.llm.common import over_batches, remainder, texts_of

#: Families of identity terms; a swap stays within its row.
FAMILIES = (
    "woman man girl boy lady gentleman",
    "women men girls boys ladies gentlemen",
    "female male nonbinary transgender",
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh",
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs",
    "black white asian latino african arab european indigenous",
    "gay straight lesbian bisexual queer heterosexual",
    "immigrant native refugee foreigner citizen",
    "immigrants natives refugees foreigners citizens",
    "american mexican chinese indian german french spanish russian turkish polish",
    "americans mexicans indians germans spaniards russians turks poles",
    "disabled blind deaf autistic paralyzed",
    "old young elderly middle-aged",
    "femme homme fille garçon",
    "femmes hommes filles garçons",
    "musulman chrétien juif bouddhiste athée",
    "musulmans chrétiens juifs bouddhistes athées",
    "frau mann mädchen junge",
    "frauen männer jungen",
    "muslime christen juden buddhisten atheisten",
    "mujer hombre chica chico",
    "mujeres hombres chicas chicos",
    "musulmán cristiano judío budista ateo",
    "musulmanes cristianos judíos budistas ateos",
)
_STRIP = ".,;:!?\"'()[]{}<>*_«»„“”‘’…¡¿-"
#: Hashed features.
SPACE = 1 << 22


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word without punctuation at its ends, and of its first letters."""
    word = word.strip(_STRIP)
    if not word:
        return []
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE]
    for n in (4, 5, 6):
        if len(word) > n:
            out.append(zlib.crc32(f"{word[:n]}*".encode("utf-8", "surrogatepass")) % SPACE)
    return out


def next_terms(families: DataFrame | None, max_terms: int = 20_000) -> dict[str, str]:
    """Each identity term, lower-cased, and the one that takes its place: the next of its family by order of the alphabet.

    A family of one has none. A term in several families counts for the first by name. Over max_terms terms raise.
    """
    if families is None:
        listed = [(i, term) for i, row in enumerate(FAMILIES) for term in row.split()]
    else:
        rows = families.select(F.col("family").cast("string").alias("f"), F.lower(F.trim(F.col("term").cast("string"))).alias("t"))
        rows = rows.where("f is not null and t is not null and t <> ''").groupBy("t").agg(F.min("f").alias("f")).limit(max_terms + 1).collect()
        if len(rows) > max_terms:
            raise ValueError(f"over {max_terms} identity terms")
        listed = [(r["f"], r["t"]) for r in rows]
    members: dict = {}
    for family, term in listed:
        members.setdefault(family, set()).add(term)
    out: dict[str, str] = {}
    for family in sorted(members, key=str):
        terms = sorted(members[family])
        if len(terms) > 1:
            for term, after in zip(terms, [*terms[1:], terms[0]], strict=True):
                out.setdefault(term, after)
    return out


def swapped(words: set[str], after: dict[str, str]) -> set[str]:
    """The words with every identity term replaced by the next of its family."""
    return {after.get(word.strip(_STRIP), word) for word in words}


def text_features(text: str, after: dict[str, str] | None = None) -> np.ndarray:
    """The set of features of a whole text, ascending; with the identity terms swapped where after is given."""
    words = set(text.lower().split())
    found: set[int] = set()
    for word in words if after is None else swapped(words, after):
        found.update(word_features(word))
    return np.array(sorted(found), np.int32)


@dataclass(frozen=True)
class Model:
    """Weights of the features that were kept, by their hash, the bias, and how many pairs of text and copy were penalised."""

    weights: dict[int, float]
    bias: float
    pairs: int = 0


#: L2 weights among which cross-validation chooses.
DECAYS = (1e-3, 1e-1, 1.0)


def _descend(r, c, dr, dc, sign, labels, size: int, bias: float, penalty: float, decay: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam. (r, c): text and feature; (dr, dc, sign): what a swap takes from a text (1) or brings to it (-1)."""
    n, w, pairs = len(labels), np.zeros(size), max(1, len(np.unique(dr)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, weights=w[c], minlength=n), -30, 30)))
        off = (p - labels) / n
        change = np.bincount(dr, weights=sign * w[dc], minlength=n)
        slope = np.bincount(c, weights=off[r], minlength=size) + 2 * penalty / pairs * np.bincount(dc, weights=sign * change[dr], minlength=size) + 2 * decay * w / max(1, size)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        mb, vb = 0.9 * mb + 0.1 * off.sum(), 0.999 * vb + 0.001 * off.sum() ** 2
        lr = 0.1 / (1 + step / 100)
        w = w - lr * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= lr * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, bias


def _places(packed: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of packed sets of places."""
    found = [np.frombuffer(p or b"", np.int32) for p in packed]
    return np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found]), np.concatenate([np.empty(0, np.int32), *found])


def fit(plain: list[bytes], swap: list[bytes | None], labels: np.ndarray, names: np.ndarray, penalty: float = 1.0, rounds: int = 300) -> Model:
    """Logistic loss + penalty * mean squared difference of the logits of a text and its swapped copy + decay * mean squared weight.

    plain: the packed places in names of each text's features; swap: those of its copy, None where no term was swapped. The
    decay is the one of DECAYS with the least loss in two-fold cross-validation. Without both labels, or without features, the
    model is the smoothed share of label 1.
    """
    n, positive, size = len(labels), int(labels.sum()), len(names)
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    paired = np.array([x is not None for x in swap], bool)
    if not positive or positive == n or not size:
        return Model({}, bias, int(paired.sum()))
    (r, c), (r2, c2) = _places(plain), _places(swap)
    of_pair = paired[r]
    mine, copy = r[of_pair].astype(np.int64) * size + c[of_pair], r2.astype(np.int64) * size + c2
    lost, won = np.setdiff1d(mine, copy), np.setdiff1d(copy, mine)
    dr, dc = np.concatenate([lost, won]) // size, np.concatenate([lost, won]) % size
    sign = np.repeat([1.0, -1.0], [len(lost), len(won)])
    decay = DECAYS[0]
    if min(positive, n - positive) >= 20:
        loss = np.zeros(len(DECAYS))
        for fold in (0, 1):
            own = np.arange(n) % 2 == fold
            place = np.cumsum(own, dtype=np.int32) - 1
            e, d = own[r], own[dr]
            for k, each in enumerate(DECAYS):
                w, b = _descend(place[r[e]], c[e], place[dr[d]], dc[d], sign[d], labels[own], size, bias, penalty, each, rounds // 3)
                logit = b + np.bincount(r, weights=w[c], minlength=n)
                loss[k] += np.logaddexp(0, np.where(labels > 0, -logit, logit))[~own].sum()
        decay = DECAYS[int(loss.argmin())]
    w, bias = _descend(r, c, dr, dc, sign, labels, size, bias, penalty, decay, rounds)
    return Model(dict(zip(names.tolist(), w.tolist(), strict=True)), float(bias), int(paired.sum()))


def _counted(rows: DataFrame, least: int, z: float, most: int) -> np.ndarray:
    """The features that tell the labels of (text, __fm_label) apart, ascending; counted on the executors."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            label = np.asarray(batch.column(1)).astype(bool)
            sets = [text_features(x) for x in batch.column(0).to_pylist()]
            names, n = np.unique(np.concatenate([np.empty(0, np.int32), *sets]), return_counts=True)
            some, k = np.unique(np.concatenate([np.empty(0, np.int32), *(x for x, y in zip(sets, label, strict=True) if y)]), return_counts=True)
            ones = np.zeros(len(names), np.int64)
            ones[np.searchsorted(names, some)] = k
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n), pa.array(ones)], ["feature", "n", "ones"])

        return apply

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__fm_label").alias("ones")).first()
    positive, rest = float(size["ones"] or 0), float(size["n"] - (size["ones"] or 0))
    counts = over_batches(rows, make, "feature int, n long, ones long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    a, b = F.col("ones") + 0.5, F.col("n") - F.col("ones") + 0.5
    odds = F.log(a / (positive - F.col("ones") + 0.5)) - F.log(b / (rest - (F.col("n") - F.col("ones")) + 0.5))
    strong = counts.where(F.col("n") >= least).select("feature", F.abs(odds / F.sqrt(1 / a + 1 / b)).alias("strength")).where(F.col("strength") > z)
    return np.array(sorted(r["feature"] for r in strong.orderBy(F.col("strength").desc(), "feature").limit(most).collect()), np.int32)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", families: DataFrame | None = None, max_rows: int = 20_000, penalty: float = 1.0, least: int = 4, z: float = 3.0, most: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Fits on at most max_rows labelled rows, those with the least hash of doc_id; the caller leaves held-out rows out.

    families: a table (family, term), see next_terms(). Features in fewer than `least` texts, or whose log odds ratio between the
    labels is within z standard errors of 0, are left out; of the rest the `most` strongest are kept and the L2 weight does
    the rest. The sample is drawn from the labels alone and is small by its bound, so it is broadcast to the texts and these are
    stored once; the driver gets only the places of kept features in each text. Rows with a null label or doc_id are not used;
    a doc_id labelled twice counts twice, and one that repeats among docs counts with each of its texts.
    """
    after = next_terms(families)
    known = labels.where(F.col(label).isNotNull() & labels[id_col].isNotNull()).select(labels[id_col].cast("long").alias("__fm_id"), (F.col(label) > 0).cast("int").alias("__fm_label"))
    sample = known.orderBy(F.xxhash64("__fm_id"), "__fm_id", "__fm_label").limit(max_rows)
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("__fm_id")).select("text", "__fm_label")
    rows = stored(rows, "sample")
    names = _counted(rows, least, z, most)

    def make():
        place = np.full(SPACE, -1, np.int32)
        place[names] = np.arange(len(names))
        packed = lambda features: (x := place[features])[x >= 0].tobytes()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            plain, swap = [], []
            for text in batch.column(0).to_pylist():
                own, other = text_features(text), text_features(text, after)
                plain.append(packed(own))
                swap.append(None if np.array_equal(own, other) else packed(other))
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(plain, pa.binary()), pa.array(swap, pa.binary())], ["label", "plain", "swap"])

        return apply

    found = over_batches(rows, make, "label int, plain binary, swap binary").toArrow()
    label, plain, swap = np.array(found["label"].to_pylist(), float), found["plain"].to_pylist(), found["swap"].to_pylist()
    del found
    return fit(plain, swap, label, names, penalty)


class _Known(dict):
    """word -> its features that the model weighs; at most `limit` words are remembered."""

    def __init__(self, model: Model, limit: int = 400_000):
        super().__init__()
        self.weights, self.limit = model.weights, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in word_features(word) if f in self.weights)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found


def scores(texts: list[str], model: Model, known: _Known) -> np.ndarray:
    logits = []
    for text in texts:
        hits = set().union(*filter(None, map(known.__getitem__, set(text.lower().split()))))
        logits.append(model.bias + sum(map(model.weights.__getitem__, sorted(hits))))
    return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -700, 700)))


def _scorer(model: Model):
    """A function of Arrow text columns; a null text scores as the empty one. The model, 20,000 weights at most, travels with the task."""
    known = _Known(model)

    def score(column: pa.Array) -> np.ndarray:
        return scores(pc.fill_null(column, "").to_pylist(), model, known)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted, penalised_pairs) per row of docs.

    Labels are learnt only where crc32(doc_id as text) mod folds is not 0; the score reads the text alone, all of it. Null and
    empty texts have the score of a text without words; a null doc_id stays null; rows that repeat each give a row; an empty
    table gives no rows, and empty labels the score 0.5. Columns of either table that are not named here are not read.
    penalised_pairs: how many labelled texts of the sample had a copy with other identity terms.
    """
    model = train(docs, labels.where(remainder(labels[id_col], folds) != 0), id_col=id_col, text_col=text_col, **fitting)

    def make():
        score = _scorer(model)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], ["doc_id", "score"])

    scored = over_batches(texts_of(docs, id_col, text_col), make, "doc_id long, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score", predicted, F.lit(model.pairs).cast("long").alias("penalised_pairs"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The rows of docs that score under threshold, with all their columns.

    The model is that of score_documents(). A null or empty text scores as one without words, a null doc_id is no reason to go,
    rows that repeat go or stay alike, and an empty table gives no rows.
    """
    model = train(docs, labels.where(remainder(labels[id_col], folds) != 0), id_col=id_col, text_col=text_col, **fitting)
    at = docs.columns.index(text_col)

    def make():
        score = _scorer(model)
        return lambda batch: batch.filter(pa.array(score(batch.column(at)) < threshold))

    return over_batches(docs, make, docs.schema)
