"""Language identification by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import materialize

#: Documents a language that the fit reads at most (in expectation; a hash of the text chooses them), rounds
#: of expectation-maximisation, and the words of evidence at which the score stops growing more certain.
FIT_DOCS, ROUNDS, EVIDENCE = 1200, 3, 12
#: Probability of a letter that is no piece, and what every piece's count is raised by.
UNKNOWN, RAISE = 1e-7, 0.02
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose scores are kept, their longest length, words scored together, and words of texts held at once.
_CACHE_WORDS, _CACHE_LETTERS, _TOGETHER, _HELD = 400_000, 40, 1 << 13, 1 << 18
UNDETERMINED = "und"


def vocabulary(path: str | None = None) -> list[str]:
    """Letter pieces of a sentencepiece model; a leading U+2581 marks the start of a word."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p and all(c == "▁" or c.isalpha() for c in p))


class Lattice:
    """The segmentations of many words at once: which piece of the vocabulary every stretch of letters is.

    The pieces form a trie whose moves (state, letter) -> state lie in one sorted array, so that all stretches of
    all words walk it together. A row number past the pieces means no piece (``none``) or a letter that is no piece
    (``unknown``).
    """

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.unknown, self.none = pieces, len(pieces), len(pieces) + 1
        moves: dict[tuple[int, str], int] = {}
        ends = [self.none]
        for k, piece in enumerate(pieces):
            state = 0
            for letter in piece:
                state = moves.setdefault((state, letter), len(ends))
                if state == len(ends):
                    ends.append(self.none)
            ends[state] = k
        keys = np.fromiter(((s << 21) | ord(c) for s, c in moves), np.int64, len(moves))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(moves.values(), np.int64, len(moves))[order]
        self.ends = np.array(ends)

    def arcs(self, words: list[str]) -> list[np.ndarray]:
        """For each length d + 1 the (words, starts) matrix of piece rows; the words must be equally long, U+2581 included."""
        size = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.int64)
        out: list[np.ndarray] = []
        live, state = np.arange(letters.size), np.zeros(letters.size, np.int64)
        for d in range(size):
            inside = live % size + d < size
            live, state = live[inside], state[inside]
            if len(self.keys):
                key = (state << 21) | letters.ravel()[live + d]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                hit = self.keys[at] == key
                live, state = live[hit], self.to[at[hit]]
            else:
                live = live[:0]
            if d and not len(live):
                break
            rows = np.full(letters.size, self.none)
            rows[live] = self.ends[state]
            rows = rows.reshape(letters.shape)[:, : size - d]
            if d == 0:
                rows = np.where(rows == self.none, self.unknown, rows)
            out.append(rows)
        return out

    def forward(self, arcs: list[np.ndarray], probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums over all segmentations up to each place, log of what each place's sums were divided by).

        probs: (pieces + 2, columns), with the unknown letter's row and one of zeros for no piece. Every 8 places the
        sums still needed are scaled, so that no word is too long for floats.
        """
        words, size = arcs[0].shape
        columns, reach = probs.shape[1], len(arcs)
        ahead = np.zeros((size + 1, words, columns))
        ahead[0] = 1.0
        shift, shifts = np.zeros((words, columns)), np.zeros((size + 1, words, columns))
        for j in range(1, size + 1):
            for d in range(min(reach, j)):
                ahead[j] += ahead[j - d - 1] * probs[arcs[d][:, j - d - 1]]
            if j % 8 == 0:
                top = ahead[j].copy()
                low = max(0, j - reach + 1)
                ahead[low : j + 1] /= top
                shift += np.log(top)
                shifts[low : j + 1] = shift
            else:
                shifts[j] = shift
        return ahead, shifts

    def scores(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log probability of each word (of letters) in each column of ``probs``."""
        out = np.empty((len(words), probs.shape[1]))
        for at, some in self.together(words):
            ahead, shifts = self.forward(self.arcs(some), probs)
            out[at] = np.log(ahead[-1]) + shifts[-1]
        return out

    @staticmethod
    def together(words: list[str]):
        """(places, marked words) of equally long words, of bounded work at a time."""
        by_size = defaultdict(list)
        for k, w in enumerate(words):
            by_size[len(w)].append(k)
        for size, places in by_size.items():
            step = max(1, 10 * _TOGETHER // (size + 1))
            for a in range(0, len(places), step):
                yield places[a : a + step], ["▁" + words[k] for k in places[a : a + step]]

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used, over all segmentations of the words, ``counts`` times each.

        probs: one probability a piece. Words hold at most 40 letters here, so plain floats are enough.
        """
        table = np.concatenate([probs, [UNKNOWN, 0.0]])[:, None]
        used = np.zeros(len(table))
        for at, some in self.together(words):
            arcs = self.arcs(some)
            size = arcs[0].shape[1]
            ahead = np.zeros((size + 1, len(some)))
            back = np.zeros((size + 1, len(some)))
            ahead[0] = back[size] = 1.0
            for j in range(1, size + 1):
                for d in range(min(len(arcs), j)):
                    ahead[j] += ahead[j - d - 1] * table[arcs[d][:, j - d - 1], 0]
            for i in range(size - 1, -1, -1):
                for d in range(min(len(arcs), size - i)):
                    back[i] += back[i + d + 1] * table[arcs[d][:, i], 0]
            some_mass = ahead[size] > 0.0  # else beyond the range of floats: no evidence
            scale = np.where(some_mass, counts[at] / np.where(some_mass, ahead[size], 1.0), 0.0)
            for d, rows in enumerate(arcs):
                for i in range(rows.shape[1]):
                    used += np.bincount(rows[:, i], scale * ahead[i] * table[rows[:, i], 0] * back[i + d + 1], len(table))
        return used[: len(probs)]


def learn_pieces(words: list[str], counts: np.ndarray, lattice: Lattice, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by expectation-maximisation over all segmentations of the counted words."""
    size = len(lattice.pieces)
    probs = np.full(size, 1.0 / max(1, size))
    for _ in range(rounds):
        got = lattice.expected(words, counts, probs) + RAISE
        probs = got / got.sum()
    return probs


def fit(docs: DataFrame, pieces: list[str] | None = None, fit_docs: int = FIT_DOCS) -> tuple[list[str], list[float], dict[str, tuple[float, ...]]]:
    """Languages, their log priors and piece -> probability in each language, from rows (text, lang).

    Counts of labels cover all rows; the piece probabilities are fitted on a bounded sample, about ``fit_docs``
    rows a language chosen by a hash of the text, one language a task. Rows with null text or lang are left out;
    of repeated rows each counts; an empty table teaches no language. The number of different labels is taken to
    fit the driver.
    """
    vocab = vocabulary() if pieces is None else pieces
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], [], {}
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, fit_docs / n)) for k, n in counts.items()], "_lang string, _share double")
    drawn = labelled.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{1,40})"), F.lit(1))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    shared = spark.sparkContext.broadcast(vocab)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        probs = learn_pieces(rows["word"].tolist(), rows["n"].to_numpy("float64"), Lattice(shared.value))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "p": [probs.tolist()]})

    learned = materialize(words.groupBy("lang").applyInPandas(learn, "lang string, p array<double>"), "pieces")
    found = {r["lang"]: r["p"] for r in learned.collect()}  # vocabulary times languages
    columns = [found.get(k) or [0.0] * len(vocab) for k in langs]
    total = sum(counts.values())
    return langs, [math.log((counts[k] + 1) / (total + len(langs))) for k in langs], {p: tuple(x or 1e-9 for x in row) for p, row in zip(vocab, zip(*columns))}


class Scorer:
    """Language and score of texts; the words' log probabilities are kept between texts."""

    def __init__(self, langs: list[str], prior: list[float], pieces: dict[str, tuple[float, ...]]) -> None:
        self.langs, self.prior = langs, np.array(prior)
        self.lattice = Lattice(list(pieces))
        width = len(langs)
        self.probs = np.array([*pieces.values(), (UNKNOWN,) * width, (0.0,) * width], dtype="float64").reshape(len(pieces) + 2, width)
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, width))

    def words(self, words: list[str]) -> np.ndarray:
        return self.lattice.scores(words, self.probs)

    def _learn(self, words: list[str]) -> None:
        """Score the words that are not in the index, and put them there."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if not fresh:
            return
        first = len(self.index)
        while first + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[first : first + len(fresh)] = self.words(fresh)
        self.index.update(zip(fresh, range(first, first + len(fresh))))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; some are split at a time, so that their words fit in memory."""
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []
        size = 0
        for t in texts:
            good = t is not None and bool(self.langs) and any(map(str.isalpha, t))
            held.append(_WORD.findall(t.lower()) if good else [])
            size += len(held[-1])
            if size > _HELD:
                out += self._judge(held)
                held, size = [], 0
        return out + self._judge(held)

    def _judge(self, held: list[list[str]]) -> list[tuple[str, float]]:
        index = self.index
        if len(index) > _CACHE_WORDS:
            index.clear()
        unseen = set().union(*held).difference(index)
        long = [w for w in unseen if len(w) > _CACHE_LETTERS]
        self._learn(sorted(unseen.difference(long)))
        apart = dict(zip(long, self.words(long))) if long else {}
        out = []
        for words in held:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            ids = [index[w] for w in words if w not in apart] if apart else list(map(index.__getitem__, words))
            total = self.prior + self.rows[ids].sum(axis=0)
            if apart:
                for w in words:
                    if w in apart:
                        total = total + apart[w]
            best = int(np.argmax(total))
            odds = np.exp((total - total[best]) * min(1.0, EVIDENCE / len(words)))
            out.append((self.langs[best], float(1.0 / odds.sum())))
        return out


def identify(docs: DataFrame, model: tuple[list[str], list[float], dict[str, tuple[float, ...]]], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (or what ``names`` says); only the text is read for it.

    ``und`` with score 0 if the text is null or has no letter (or nothing was learned); else a learned
    language and its share of the probability, tempered to the evidence of at most EVIDENCE words. Languages
    that tie go by name. Repeated rows are judged alike and all kept; an empty table gives no rows. Other columns
    pass unchanged; one that has the name of a new column raises ValueError.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # pieces of the vocabulary times languages: fixed, whatever the input
    columns = docs.columns
    if clash := {c.lower() for c in columns} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} are there already; give other names")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = f"c{columns.index(text_col)}"
    schema = T.StructType([*numbered.schema.fields, T.StructField("p0", T.StringType()), T.StructField("p1", T.DoubleType())])

    def run(batches):
        scorer = Scorer(*shared.value)
        for b in batches:
            found = scorer.texts(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*b.schema.names, "p0", "p1"])

    return numbered.mapInArrow(run, schema).toDF(*columns, *names)
