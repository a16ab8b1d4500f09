"""Language of words and documents by a linear-chain conditional random field.

Each word of a text is labelled; a word's emission scores are the sums of learned
weights of its affixes, character n-grams and itself (hashed features), and learned
transition weights join neighbours. Forward-backward over chains of ``CHAIN`` words
(every word of the text is in exactly one chain) gives each word a distribution over
languages; a document's language is the one with the largest mean, weighted by
word length, and that mean is the score.

Training takes a bounded, documented sample: the ``DOCS_PER_LANG`` different rows of each
language with the smallest hash of id and text, ``SAMPLE_CHARS`` characters of each. Rows of each language
are counted first; the counts give a bound on the hash under which little more than the sample lies, so that
only those rows leave their tasks. As documents carry one
label, chains for training are also spliced from several languages, so that the
transitions learn how texts switch.

Defined results: null text, or text without a letter (numerals such as one half or a Roman numeral
sign are none), is ``und`` with score 0; ties between languages go to the first by name; rows that
repeat an id are judged each by its own text, and count once in training if id, text and language are equal; with no
labelled row everything is ``und``; an empty table gives an empty result; other columns are ignored or kept as they are, and
result columns get an underscore where the id column has their name.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilter.llm.common import arrow_map, free

DOCS_PER_LANG, SAMPLE_CHARS = 150, 2500
DIM_BITS, CHAIN, MEMO_WORDS = 15, 128, 120_000
DIM = 1 << DIM_BITS
EPOCHS, RATE, L2, SWITCHED = 3, 0.5, 1e-6, 0.3
UNDETERMINED = "und"
#: Most words that are held as arrays at once.
BLOCK_WORDS = 1 << 18

WORD = re.compile(r"[^\W\d_]+")
NOT_LETTER = re.compile("|".join(map(re.escape, (c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()))))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters. Numerals that are word characters but neither digits nor letters part words."""
    words = WORD.findall(text.lower())
    if "".join(words).isalpha():
        return words
    return [p for w in words for p in (NOT_LETTER.split(w) if not w.isalpha() else (w,)) if p]


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _bucket(salt: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(codes[0].shape, salt * 2 + 1, np.uint64) * _MIX[3]
    for c in codes:
        h = (h ^ c) * _MIX[0]
        h ^= h >> np.uint64(29)
    return ((h * _MIX[1]) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of many words at once, as (feature, index of its word).

    The word itself, prefixes and suffixes of 1 to 3, framed n-grams of 1 to 4 characters.
    """
    c = np.frombuffer(("\0\0" + "\0".join(words) + "\0\0").encode("utf-32-le"), "<u4").astype(np.uint64)
    at = np.flatnonzero(c)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    prev, one, two, three = c[at - 1], c[at], c[at + 1], c[np.minimum(at + 2, len(c) - 1)]
    inner = two != 0
    feats = [_bucket(1, one), _bucket(2, one, two), _bucket(3, prev, one, two), _bucket(4, prev, one, two, three)[inner]]
    index = [word, word, word, word[inner]]
    start = at[np.cumsum(sizes) - sizes]
    end = start + sizes - 1
    own = np.arange(len(words))
    for n in (1, 2, 3):
        fits = sizes >= n
        feats += [_bucket(4 + n, *(c[start[fits] + k] for k in range(n))), _bucket(8 + n, *(c[end[fits] - k] for k in range(n)))]
        index += [own[fits], own[fits]]
    power = np.cumprod(np.full(int(sizes.max()), _MIX[2], np.uint64))
    whole = np.add.reduceat(one * power[at - np.repeat(start, sizes)], np.cumsum(sizes) - sizes)
    return np.concatenate([*feats, _bucket(0, whole)]), np.concatenate([*index, own])


class Crf:
    """Weights and the forward-backward pass."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((DIM, len(labels)))
        self.transitions = np.zeros((len(labels), len(labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        f, w = word_features(words)
        return np.stack([np.bincount(w, self.weights[f, k], len(words)) for k in range(len(self.labels))], axis=1)

    def marginals(self, emit: np.ndarray, mask: np.ndarray, pairs: bool = False):
        """emit: chains x words x labels. Marginals of words; with pairs also summed expected transitions."""
        n, length, k = emit.shape
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        t = np.exp(self.transitions - self.transitions.max())
        alpha = np.empty_like(e)
        beta = np.ones_like(e)
        a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        alpha[:, 0] = a
        for i in range(1, length):
            step = (a @ t) * e[:, i]
            step /= step.sum(axis=1, keepdims=True)
            a = np.where(mask[:, i, None], step, a)
            alpha[:, i] = a
        b = beta[:, length - 1].copy()
        expected = np.zeros((k, k))
        for i in range(length - 2, -1, -1):
            m = mask[:, i + 1, None]
            eb = e[:, i + 1] * b
            if pairs:
                joint = alpha[:, i, :, None] * t * eb[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                expected += (joint * m[..., None]).sum(axis=0)
            step = eb @ t.T
            step /= step.sum(axis=1, keepdims=True)
            b = np.where(m, step, b)
            beta[:, i] = b
        out = alpha * beta
        out /= out.sum(axis=2, keepdims=True)
        return (out, expected) if pairs else out


def fit(samples: list[tuple[str, str]], seed: int = 5) -> Crf | None:
    """A field trained on (text, label) by mini-batch gradient ascent with AdaGrad steps."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    rng, crf = np.random.default_rng(seed), Crf(labels)
    code = {x: i for i, x in enumerate(labels)}
    chains: list[tuple[list[str], list[int]]] = []
    by: dict[int, list[list[str]]] = {}
    for text, lang in samples:
        words = words_of(text)
        for i in range(0, len(words), 64):
            by.setdefault(code[lang], []).append(words[i : i + 64])
    for k, pieces in by.items():
        chains += [(p, [k] * len(p)) for p in pieces]
    if len(by) > 1:
        kinds = sorted(by)
        for _ in range(int(SWITCHED * len(chains))):
            words, tags = [], []
            while len(words) < 48:
                k = kinds[int(rng.integers(len(kinds)))]
                piece = by[k][int(rng.integers(len(by[k])))]
                n = int(rng.integers(3, 20))
                words += piece[:n]
                tags += [k] * len(piece[:n])
            chains.append((words, tags))
    known = {w: i for i, w in enumerate(sorted({w for words, _ in chains for w in words}))}
    f, w = word_features(list(known))
    by_word = np.argsort(w, kind="stable")
    features, ends = f[by_word], np.cumsum(np.bincount(w, minlength=len(known)))
    counts = np.diff(ends, prepend=0)
    gw, gt = np.full_like(crf.weights, 1e-2), np.full_like(crf.transitions, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), 64):
            batch = [chains[i] for i in order[at : at + 64]]
            length = max(len(w) for w, _ in batch)
            mask = np.arange(length) < np.array([[len(w)] for w, _ in batch])
            gold = np.zeros((len(batch), length), np.int64)
            gold[mask] = [t for _, tags in batch for t in tags]
            ids = np.array([known[w] for words, _ in batch for w in words])
            n = counts[ids]
            r = np.repeat(np.flatnonzero(mask), n)
            f = features[np.repeat(ends[ids] - np.cumsum(n), n) + np.arange(n.sum())]
            emit = np.stack([np.bincount(r, crf.weights[f, k], len(batch) * length) for k in range(len(labels))], axis=1).reshape(len(batch), length, -1)
            p, expected = crf.marginals(emit, mask, pairs=True)
            off = ((np.eye(len(labels))[gold] - p) * mask[..., None]).reshape(-1, len(labels))
            scale = 1 / mask.sum()
            seen = np.unique(f)
            at_f = np.searchsorted(seen, f)
            grad = np.stack([np.bincount(at_f, off[r, k], len(seen)) for k in range(len(labels))], axis=1) * scale - L2 * crf.weights[seen]
            gw[seen] += grad**2
            crf.weights[seen] += RATE * grad / np.sqrt(gw[seen])
            real = np.zeros_like(crf.transitions)
            np.add.at(real, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
            grad_t = (real - expected) * scale
            gt += grad_t**2
            crf.transitions += RATE * grad_t / np.sqrt(gt)
    crf.weights = crf.weights.astype(np.float32)
    return crf


class Labeller:
    """Emissions of words are remembered in a table emptied when it is full."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.rows = np.zeros((MEMO_WORDS, len(crf.labels)), np.float32)
        self.known: dict[str, int] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(fresh) > MEMO_WORDS:
            known.clear()
            fresh = list(dict.fromkeys(words))
        if len(fresh) > len(self.rows):
            self.rows = np.zeros((len(fresh), len(self.crf.labels)), np.float32)
        for i in range(0, len(fresh), 1 << 16):
            part = fresh[i : i + (1 << 16)]
            self.rows[len(known) : len(known) + len(part)] = self.crf.emissions(part)
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
        at = list(map(known.__getitem__, words))
        return self.rows[at]

    def documents(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Weighted sums of the words' marginals and of weights for each document."""
        k = len(self.crf.labels)
        sums, weights = np.zeros((len(texts), k)), np.zeros(len(texts))
        starts, at = [], 0
        while at < len(texts):
            words: list[str] = []
            chains: list[tuple[int, int, int]] = []  # document, start, length
            while at < len(texts) and (not words or len(words) < BLOCK_WORDS):
                own = texts[at]
                for i in range(0, len(own), CHAIN):
                    chains.append((at, len(words) + i, min(CHAIN, len(own) - i)))
                words += own
                at += 1
            if not words:
                continue
            emit = self.emissions(words)
            size = np.fromiter(map(len, words), np.float64, len(words))
            doc, start, n = np.array(chains).T
            for lo in range(0, len(n), 4096):
                d, s, m = doc[lo : lo + 4096], start[lo : lo + 4096], n[lo : lo + 4096]
                step = np.arange(m.max())
                mask = step < m[:, None]
                idx = np.where(mask, s[:, None] + step, 0)
                p = self.crf.marginals(emit[idx], mask)
                w = size[idx] * mask
                np.add.at(sums, d, (p * w[..., None]).sum(axis=1))
                np.add.at(weights, d, w.sum(axis=1))
        return sums, weights


def _predict(texts: list[str | None], labeller: Labeller | None) -> tuple[list[str], list[float]]:
    words = [words_of(t) if t else [] for t in texts]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if labeller is not None:
        sums, weights = labeller.documents(words)
        mean = sums / np.maximum(weights, 1e-9)[:, None]
        best = mean.argmax(axis=1)
        for i in np.flatnonzero(weights > 0):
            langs[i], scores[i] = labeller.crf.labels[best[i]], float(min(1.0, mean[i, best[i]]))
    return langs, scores


def _label_batches(batches: Iterator[pa.RecordBatch], crf: Crf | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(crf) if crf else None
    for batch in batches:
        langs, scores = _predict(batch.column(2).to_pylist(), labeller)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)


def _keep_batches(batches: Iterator[pa.RecordBatch], crf: Crf | None, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(crf) if crf else None
    for batch in batches:
        langs, scores = _predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), labeller)
        yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column) -> list[tuple[str, str]]:
    """Up to DOCS_PER_LANG different texts of each language, those with the smallest hash; little more than that reaches the driver."""
    named = df.where(usable & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in named.groupBy(F.col(lang_col)).agg(F.count(F.lit(1))).collect()}
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = named.where(F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang_"), key.alias("key_"), F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("text_"))
    found: dict[str, list[tuple[int, str]]] = {}
    share = {lang: (DOCS_PER_LANG + 8 * DOCS_PER_LANG**0.5) / n for lang, n in counts.items()}
    while share:
        bounds = {lang: min(2**63 - 1, int(2**64 * s) - 2**63) for lang, s in share.items()}
        bound = F.create_map(*(F.lit(x) for pair in sorted(bounds.items()) for x in pair))[F.col("lang_")]
        got: dict[str, list[tuple[int, str]]] = {lang: [] for lang in share}
        for r in rows.where(F.col("key_") <= bound).distinct().collect():
            got[r["lang_"]].append((r["key_"], r["text_"]))
        found |= got
        # few texts under the bound, because many are null or equal: the bound rises
        share = {lang: 8 * s for lang, s in share.items() if len(got[lang]) < DOCS_PER_LANG and s < 1}
    return [(text, lang) for lang in sorted(found) for _, text in sorted(found[lang])[:DOCS_PER_LANG]]


def held_out(id_col: str) -> Column:
    """Rows never trained on: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def label(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id_col, held_out, lang_pred, score of every row."""
    crf = fit(training_sample(df, id_col, text_col, lang_col, ~held_out(id_col)))
    names = [id_col, *(free(n, (id_col,)) for n in ("held_out", "lang_pred", "score"))]
    rows = df.select(F.col(id_col), held_out(id_col).alias(names[1]), F.col(text_col).alias(free("text_", names)))
    return arrow_map(rows, partial(_label_batches, crf=crf, names=names), f"`{id_col}` {dict(df.dtypes)[id_col]}, `{names[1]}` boolean, `{names[2]}` string, `{names[3]}` double")


def keep_identified(df: DataFrame, id_col: str, text_col: str, lang_col: str, least: float = 0.5) -> DataFrame:
    """The rows whose language is determined with a score of at least ``least``, columns unchanged."""
    crf = fit(training_sample(df, id_col, text_col, lang_col, ~held_out(id_col)))
    return arrow_map(df, partial(_keep_batches, crf=crf, text_col=text_col, least=least), df.schema)
