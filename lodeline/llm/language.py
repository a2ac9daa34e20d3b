"""Language of notes and of their lines by segmentation-marginalised unigrams.

Each language is a unigram distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, computed by the
forward algorithm for all distinct words of a batch at once; a line is scored by its words.
The distributions are fitted by expectation-maximisation over segmentations on a bounded
sample of labelled documents (at most ``FIT_DOCS`` documents and ``FIT_CHARS`` characters),
whose lines are relabelled between rounds, so wrong labels and mixed documents in the sample
do little harm.

Quoted words, markup, addresses of pages, data (``{...}``) and names of special tokens are
no running text. A document without running text has no language. Every line with running
text gets its most probable language with the posterior as its confidence, however short it
is. A document is mixed if lines judged with a confidence of at least ``SURE`` are in several
languages; it is given line by line, any other as a whole (segment 0).

Words, or runs of scripts without spaces, of more than ``MAX_WORD`` characters are scored in
parts of that length, so no product leaves the range of the floats. Null, empty and blank
texts have no language. Repeated rows give repeated results. Lines are separated by line
feeds and counted from 1; a carriage return before one is no text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER, VOCABULARY = "/opt/tokenizers", "piece_bpe_32k.model"
FIT_DOCS, FIT_CHARS, EM_ROUNDS, RELABELS = 3000, 8_000_000, 3, 2
LANGUAGES = ("de", "en", "es", "fr", "ja", "pt", "zh")
# Codes of the languages in ISO 639-1, 639-2 and by name.
CODES = {"de": "de", "deu": "de", "ger": "de", "german": "de", "en": "en", "eng": "en", "english": "en", "es": "es", "spa": "es", "spanish": "es", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "ja": "ja", "jp": "ja", "jpn": "ja", "japanese": "ja", "pt": "pt", "por": "pt", "portuguese": "pt", "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "cn": "zh", "chinese": "zh"}
#: Confidence from which lines in other languages make a document mixed, and letters a line of the sample needs to be relabelled.
SURE, RELABEL = 0.9, 4
MAX_WORD = 40
#: Nats a character costs about: products are kept near 1 by as much a character.
COST = 6.0

_QUOTES = frozenset("“„«「『‹\"")
_QUOTED = re.compile(r"[“„][^“”„\n]*[”“]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|‹[^›\n]*›|\"[^\"\n]*\"")
_NOT_TEXT = re.compile(r"https?://\S+|www\.\S+|<\|[a-z_]+\|>|<[^>\n]*>|`[^`\n]*`|\{[^}\n]*\}|\[[^\]\n]*\]\([^)\n]*\)")
_NOT_TEXT_SIGNS = ("http", "www.", "<", "`", "{", "](")
_MAILS = re.compile(r"\S+@\S+")
_W = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff々"
_WORD = re.compile(rf"[{_W}]{{1,{MAX_WORD}}}|[^\W\d_{_W}]+(?:['’][^\W\d_{_W}]+)*")


def running(text: str) -> str:
    """The running text of a text, in lower case; what is left out becomes a space, lines stay."""
    if not _QUOTES.isdisjoint(text):
        text = _QUOTED.sub(" ", text)
    if any(x in text for x in _NOT_TEXT_SIGNS):
        text = _NOT_TEXT.sub(" ", text)
    if "@" in text:
        text = _MAILS.sub(" ", text)
    return text.lower()


def words_of(line: str) -> list[str]:
    """Words of a line of :func:`running` text; runs of scripts without spaces count as words. Longer ones are cut."""
    words = _WORD.findall(line)
    if len(line) > MAX_WORD and max(map(len, words), default=0) > MAX_WORD:
        words = [w[i : i + MAX_WORD] for w in words for i in range(0, len(w), MAX_WORD)]
    return words


CLASSES = ("<kana>", "<han>", "<latin>", "<other>")


def _class(c: str) -> int:
    n = ord(c)
    if 0x3040 <= n <= 0x30FF:
        return 0
    if 0x3400 <= n <= 0x9FFF or 0xF900 <= n <= 0xFAFF:
        return 1
    return 2 if n < 0x250 else 3


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[str, ...]:
    """The pieces of the vocabulary, in lower case; a leading mark stands for the start of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i)}))


class Lattice:
    """All segmentations of some words: an edge for each piece at each place, from any single character on.

    ``known`` maps a piece to its number, and a mere beginning of pieces to -1. Characters
    that are no piece stand for their class, the numbers after the pieces.
    """

    def __init__(self, words: list[str], known: dict[str, int], n_pieces: int) -> None:
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        word, start, length, piece = [], [], [], []
        get = known.get
        for k, w in enumerate(words):
            s = "▁" + w
            n = len(s)
            for i in range(n):
                one = get(s[i], None)
                word.append(k)
                start.append(i)
                length.append(1)
                piece.append(one if one is not None and one >= 0 else n_pieces + _class(s[i]))
                j = i + 2
                while j <= n and (one is not None or j == i + 2):
                    one = get(s[i:j])
                    if one is None:
                        break
                    if one >= 0:
                        word.append(k)
                        start.append(i)
                        length.append(j - i)
                        piece.append(one)
                    j += 1
        order = np.lexsort((length, start))
        self.word, self.start, self.length, self.piece = (np.array(x, np.int64)[order] for x in (word, start, length, piece))
        # steps: edges of one start and length, so that no word occurs twice in a step
        new = np.flatnonzero((np.diff(self.start) != 0) | (np.diff(self.length) != 0)) + 1
        self.steps = list(zip(np.r_[0, new], np.r_[new, len(order)])) if len(order) else []

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(place, word, language) sums over all beginnings; ``p`` has an edge's probability by language."""
        f = np.zeros((int(self.size.max(initial=0)) + 1, len(self.size), p.shape[1]))
        f[0] = 1
        for a, b in self.steps:
            i, j = self.start[a], self.start[a] + self.length[a]
            w = self.word[a:b]
            f[j, w] += f[i, w] * p[a:b]
        return f

    def backward(self, p: np.ndarray) -> np.ndarray:
        g = np.zeros((int(self.size.max(initial=0)) + 1, len(self.size), p.shape[1]))
        g[self.size, np.arange(len(self.size))] = 1
        for a, b in reversed(self.steps):
            i, j = self.start[a], self.start[a] + self.length[a]
            w = self.word[a:b]
            g[i, w] += g[j, w] * p[a:b]
        return g

    def ends(self, f: np.ndarray) -> np.ndarray:
        return f[self.size, np.arange(len(self.size))]


def _blocks(words: list[str], most: int = 8192) -> Iterator[list[str]]:
    """Words of about one length together."""
    by = sorted(words, key=len)
    for i in range(0, len(by), most):
        yield by[i : i + most]


@dataclass
class Model:
    """Probabilities of pieces and then classes, a column of ``LANGUAGES`` each."""

    known: dict[str, int] = field(default_factory=dict)
    n_pieces: int = 0
    table: np.ndarray | None = None
    _cache: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def words(self, words: set[str]) -> dict[str, np.ndarray]:
        """Log probability of each word in each language, over all segmentations."""
        if len(self._cache) > 200_000:
            self._cache.clear()
        for block in _blocks([w for w in words if w not in self._cache]):
            x = Lattice(block, self.known, self.n_pieces)
            p = self.table[x.piece] * np.exp(COST * x.length)[:, None]
            score = np.log(x.ends(x.forward(p))) - COST * x.size[:, None]
            self._cache.update(zip(block, score))
        return self._cache

    def posteriors(self, lines: list[list[str]]) -> np.ndarray:
        """Of lines, each of at least one word."""
        if not lines:
            return np.empty((0, len(LANGUAGES)))
        number: dict[str, int] = {}
        at = [number.setdefault(w, len(number)) for x in lines for w in x]
        score = self.words(set(number))
        each = np.array([score[w] for w in number])
        s = np.add.reduceat(each[at], np.r_[0, np.cumsum([len(x) for x in lines])[:-1]])
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _with_beginnings(known: dict[str, int]) -> dict[str, int]:
    out = dict(known)
    for p in known:
        for i in range(1, len(p)):
            out.setdefault(p[:i], -1)
    return out


def fit(docs: list[tuple[str, str]], path: str) -> Model:
    """A model from (text, language) of a bounded sample."""
    vocabulary = pieces(path)
    n, width = len(vocabulary), len(vocabulary) + len(CLASSES)
    known = _with_beginnings({p: i for i, p in enumerate(vocabulary)})
    lines = [(w, l) for text, l in docs for x in running(text).split("\n") if (w := words_of(x))]
    model = Model()
    for round_ in range(RELABELS + 1):
        by: dict[str, Counter] = defaultdict(Counter)
        for w, l in lines:
            by[l].update(w)
        uses = np.zeros((width, len(LANGUAGES)))
        for k, l in enumerate(LANGUAGES):
            blocks = [(Lattice(b, known, n), np.array([by[l][w] for w in b], float)) for b in _blocks(list(by[l]))]
            use = sum((np.bincount(x.piece, c[x.word], width) for x, c in blocks), np.zeros(width))
            for _ in range(EM_ROUNDS):
                prob = use / max(1.0, use.sum())
                prob = np.where(prob > 0, prob, np.where(np.arange(width) < n, 1e-9, 1e-6))
                use = np.zeros(width)
                for x, c in blocks:
                    p = (prob[x.piece] * np.exp(COST * x.length))[:, None]
                    f, g = x.forward(p), x.backward(p)
                    at = x.start + x.length
                    through = (f[x.start, x.word] * p * g[at, x.word])[:, 0]
                    use += np.bincount(x.piece, c[x.word] * through / x.ends(f)[x.word, 0], width)
            uses[:, k] = use
        total = uses.sum(0)
        seen = {p: i for i, p in enumerate(vocabulary) if uses[i].any()}
        model = Model(_with_beginnings(seen), n, (uses + 0.01) / (total + 0.01 * n))
        if round_ < RELABELS and lines:
            best = model.posteriors([w for w, _ in lines]).argmax(1)
            lines = [(w, LANGUAGES[b] if sum(map(len, w)) >= RELABEL else l) for (w, l), b in zip(lines, best)]
    return model


def judge(m: Model, texts: list[str]) -> list[tuple[list[tuple[int, str, float]], str | None, float, bool]]:
    """Of each text: its lines (number from 1, language, confidence), language and confidence of the whole, whether it is mixed."""
    lines = [(k, i, w) for k, text in enumerate(texts) for i, x in enumerate(running(text).split("\n"), 1) if (w := words_of(x))]
    p = m.posteriors([w for _, _, w in lines])
    best = p.argmax(1)
    each: list[list[int]] = [[] for _ in texts]
    for row, (k, _, _) in enumerate(lines):
        each[k].append(row)
    out = []
    for rows in each:
        if not rows:
            out.append(([], None, 0.0, False))
            continue
        whole = np.log(p[rows] + 1e-12).sum(0)
        q = np.exp(whole - whole.max())
        q /= q.sum()
        sure = {int(best[r]) for r in rows if p[r, best[r]] >= SURE}
        k = sure.pop() if len(sure) == 1 else int(q.argmax())
        out.append(([(lines[r][1], LANGUAGES[best[r]], float(p[r, best[r]])) for r in rows], LANGUAGES[k], float(q[k]), len(sure) > 1))
    return out


# ---------------------------------------------------------------------------- Spark


def label_code(lang: Column) -> Column:
    """One code for the spellings of a language label; null where it is missing or says nothing; the label itself where it is unknown here."""
    base = F.lower(F.trim(F.element_at(F.split(F.regexp_replace(lang, "_", "-"), "-"), 1)))
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.when(lang.isNull() | F.trim(lang).eqNullSafe("") | base.isin("und", "unknown", "none", "null", "n/a", "mul", "zxx"), F.lit(None)).otherwise(F.coalesce(table[base], base))


def fit_model(df: DataFrame, row_id: str, text: str, lang: str, folder: str = FOLDER) -> Model:
    """The model of a table, from at most ``FIT_DOCS`` of its labelled rows, chosen by a hash of id and text, and of ``FIT_CHARS`` characters in all."""
    rows = df.select(F.col(row_id).alias("i"), F.col(text).alias("t"), label_code(F.col(lang)).alias("l")).where(F.col("l").isin(*LANGUAGES) & (F.length("t") > 0) & (F.length("t") <= FIT_CHARS))
    every = max(1, math.ceil(rows.count() / (0.9 * FIT_DOCS)))
    chosen = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(every)) == 0).orderBy(F.xxhash64("i", "t"), "i").limit(FIT_DOCS)
    w = Window.orderBy(F.xxhash64("i", "t"), "i")  # over at most FIT_DOCS rows
    sample = chosen.withColumn("_n", F.sum(F.length("t")).over(w)).where(F.col("_n") <= FIT_CHARS).collect()
    return fit([(r.t, r.l) for r in sample], f"{folder}/{VOCABULARY}")


_JUDGED = T.StructType([T.StructField("segment", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("mixed", T.BooleanType()), T.StructField("label", T.StringType())])


def judge_rows(df: DataFrame, row_id: str, text: str, lang: str, folder: str = FOLDER) -> DataFrame:
    """One row a document (segment 0), and for documents in several languages one a line: row_id, segment, lang, confidence, mixed, label.

    ``label`` is the code of the given label, null where it is missing. Documents without running text have no row.
    """
    model = fit_model(df, row_id, text, lang, folder)
    rows = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("_id"), F.col(text).alias("_t"), label_code(F.col(lang)).alias("_l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids, texts, labels = (batch.column(k).to_pylist() for k in range(3))
            for i, l, (lines, whole, sure, mixed) in zip(ids, labels, judge(model, texts)):
                if whole is None:
                    continue
                for segment, lang_, conf in [(0, whole, sure), *(lines if mixed else [])]:
                    for c, v in zip(out, (i, segment, lang_, conf, mixed, l)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.string())], names=[row_id, *_JUDGED.names])

    return rows.mapInArrow(run, T.StructType([T.StructField(row_id, df.schema[row_id].dataType), *_JUDGED.fields]))


def find_wrong(judged: DataFrame) -> DataFrame:
    """Lines of mixed documents, and other documents whose label is missing or names another language."""
    line = F.col("mixed") & (F.col("segment") > 0)
    whole = ~F.col("mixed") & (F.col("label").isNull() | (F.col("label") != F.col("lang")))
    return judged.where(line | whole)
