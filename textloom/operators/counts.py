"""Counts of the tokens of many documents at once: a lot of documents is some flat arrays, and every kind of entry is counted by one sort of whole numbers.

Helpers of ``profile`` that run in the tasks. Nothing is done for a single token; texts are looked at once for each distinct one of a lot.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from textloom.operators.arcs import Batch, baseline

# Task functions of this module travel with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that are counted at once; a longer document is a lot of its own.
HELD_TOKENS = 1 << 18
#: Scores that differ by no more may be equal when they are rounded.
ROUNDED = 2e-6
COUNTS = ("struct<tags:array<struct<upos:string,n:bigint>>,lemmas:array<struct<lemma:string,n:bigint>>,tagged:array<struct<upos:string,lemma:string,n:bigint>>,"
          "deps:array<struct<dep:string,n:bigint>>,arcs:array<struct<arc:string,n:bigint>>,cells:array<double>,terms:array<struct<term:string,score:double>>>")


class Coded:
    """A text column as numbers of its distinct values; ``place`` is the place of each of them in their order, nulls last."""

    def __init__(self, column: pa.Array):
        found = column.dictionary_encode()
        self.names = [*found.dictionary.to_pylist(), None]
        self.codes = pc.fill_null(found.indices.cast(pa.int64()), len(self.names) - 1).to_numpy(zero_copy_only=False)
        self.place = np.empty(len(self.names), np.int64)
        self.place[sorted(range(len(self.names)), key=lambda i: (self.names[i] is None, self.names[i] or ""))] = np.arange(len(self.names))

    def told(self, of: Callable[[str], object], kind: type) -> np.ndarray:
        """What ``of`` tells of the value of each row."""
        return np.array([of(n or "") for n in self.names], kind)[self.codes]

    def texts(self, codes: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(codes))


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys: the order that brings them together, where each run starts in it, and how long it is."""
    order = np.argsort(key, kind="stable")
    at = key[order]
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))[:len(at)])
    return order, start, np.diff(np.append(start, len(at)))


def distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of ``n`` groups has."""
    width = int(value.max(initial=0)) + 1
    return np.bincount(np.unique(group * width + value) // width, minlength=n)


def best(group: np.ndarray, k: int, *by: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of every group in the order of ``by``, group by group."""
    order = np.lexsort((*by[::-1], group))
    at = group[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def lists(doc: np.ndarray, documents: int, **fields: pa.Array) -> pa.Array:
    """Entries in the order of their documents as one list for each document."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=documents))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def counter(dim: int, shortest: int, first: dict[str, int], stop: dict[str, set[str]], bases: dict[tuple[str, str], str]) -> Callable[..., pa.Array]:
    """A task function of (lang, sentences of the document as structs of sent_id, toks and upos, their number by the lexical statistics).

    ``shortest`` is the length of a term at least and ``first`` how many lemmas, lemmas of a tag, arcs and terms are wanted; what cannot be among them is not
    returned. ``stop`` and ``bases`` hold stop words and dictionary forms for tokens that lack ``is_stop`` and ``lemma``.
    """
    def flags(column: pa.Array) -> np.ndarray:
        return pc.fill_null(column, False).to_numpy(zero_copy_only=False)

    def of_lot(lang: pa.Array, column: pa.Array, sentences: np.ndarray) -> pa.Array:
        documents = len(column)
        docs, sents = Batch(column), column.flatten()
        inner = Batch(sents.field("toks"))
        toks, upos = sents.field("toks").flatten(), Coded(sents.field("upos").flatten())
        sent_id = sents.field("sent_id").to_numpy(zero_copy_only=False).astype(np.int64)
        doc, at, text, lower = docs.of[inner.of], sent_id[inner.of] << 32 | inner.at, Coded(toks.field("text")), Coded(toks.field("lower"))
        alpha, named = flags(toks.field("is_alpha")), [f.name for f in toks.type]
        if "lemma" in named:
            is_stop, lemma = flags(toks.field("is_stop")), Coded(toks.field("lemma"))
        else:  # by distinct pairs of language and word
            of_language = Coded(lang)
            pair, back = np.unique(of_language.codes[doc] * len(lower.names) + lower.codes, return_inverse=True)
            pairs = [(of_language.names[p // len(lower.names)] or "", lower.names[p % len(lower.names)]) for p in pair.tolist()]
            is_stop = np.array([w in stop.get(code, ()) for code, w in pairs], bool)[back]
            lemma = Coded(pa.array([bases.get(p, p[1]) for p in pairs], pa.string()).take(pa.array(back)))
        arcs = baseline(sents.field("upos"))
        dep, head = Coded(arcs.field("dep").flatten()), inner.start + arcs.field("head").flatten().to_numpy(zero_copy_only=False)
        content = np.flatnonzero(alpha & ~is_stop)
        out = {}

        def counted(some: np.ndarray, *parts: tuple[Coded, np.ndarray]) -> tuple[np.ndarray, ...]:
            """Document, codes, number and first place of each distinct entry of the tokens ``some``."""
            key = doc[some]
            for p, codes in parts:
                key = key * len(p.names) + codes
            order, start, n = runs(key)
            one = order[start]
            return doc[some][one], *[codes[one] for _, codes in parts], n, np.minimum.reduceat(at[some][order], start) if len(start) else at[:0]

        whole = np.arange(inner.n)
        for name, field, p in (("tags", "upos", upos), ("deps", "dep", dep)):
            of, code, n, _ = counted(whole, (p, p.codes))
            out[name] = lists(of, documents, **{field: p.texts(code), "n": pa.array(n)})
        of, code, n, _ = counted(content, (lemma, lemma.codes[content]))
        kept = best(of, first["lemmas"], -n, lemma.place[code])
        out["lemmas"] = lists(of[kept], documents, lemma=lemma.texts(code[kept]), n=pa.array(n[kept]))
        tag = Coded(pa.array([u or "X" for u in upos.names], pa.string()).take(pa.array(upos.codes)))
        of, label, code, n, place = counted(content, (tag, tag.codes[content]), (lemma, lemma.codes[content]))
        kept = best(of * len(tag.names) + label, first["tagged"], -n, place, lemma.place[code])
        out["tagged"] = lists(of[kept], documents, upos=tag.texts(label[kept]), lemma=lemma.texts(code[kept]), n=pa.array(n[kept]))
        above = upos.codes[head]
        some = np.flatnonzero(above < len(upos.names) - 1)
        of, up, code, n, place = counted(some, (upos, above[some]), (dep, dep.codes[some]))
        arc = Coded(pc.binary_join_element_wise(upos.texts(up), dep.texts(code), "->"))
        kept = best(of, first["arcs"], -n, place, arc.place[arc.codes])
        out["arcs"] = lists(of[kept], documents, arc=arc.texts(arc.codes[kept]), n=pa.array(n[kept]))
        words = np.flatnonzero(alpha)
        digests = [hashlib.md5((w or "").encode()).hexdigest() for w in lower.names]
        cell = np.array([int(x[:6], 16) % dim for x in digests])[lower.codes[words]]
        sign = np.array([1 if x[6] in "01234567" else -1 for x in digests])[lower.codes[words]]
        cells = np.bincount(doc[words] * dim + cell, weights=sign, minlength=documents * dim)
        out["cells"] = pa.ListArray.from_arrays(pa.array(np.arange(documents + 1, dtype=np.int32) * dim), pa.array(cells.astype(np.float64)))
        out["terms"] = terms(words, doc, inner, at, text, lower, is_stop, documents, sentences)
        return pa.StructArray.from_arrays(list(out.values()), names=list(out))

    def terms(words, doc, inner, at, text, lower, is_stop, documents, sentences) -> pa.Array:
        """The best terms by the scheme of ``keywords.keywords_yake``, and those that may be equal to the last of them when scores are rounded."""
        none, same = len(lower.names), inner.of[words][1:] == inner.of[words][:-1]
        code = lower.codes[words]
        left, right = np.full(len(words), none), np.full(len(words), none)
        left[1:][same], right[:-1][same] = code[:-1][same], code[1:][same]
        pair, back = np.unique(text.codes * none + lower.codes, return_inverse=True)
        acronym = text.told(lambda x: x.upper() == x, bool) & np.array([text.names[p // none] != lower.names[p % none] for p in pair.tolist()], bool)[back]
        capital = text.told(lambda x: x[:1].upper() == x[:1] and x[:1].lower() != x[:1], bool) & (inner.at > 0)
        wanted = np.flatnonzero(~is_stop[words] & lower.told(lambda x: len(x) >= shortest, bool)[words])
        code, left, right, words = code[wanted], left[wanted], right[wanted], words[wanted]
        # Sorted by document, term and sentence, so that the middle sentence of a term is a place in its run.
        order, start, n = runs(doc[words] * none + code)
        inside = np.repeat(np.arange(len(start)), n)
        group = np.empty(len(words), np.int64)
        group[order] = inside
        sent = at[words] >> 32
        sent_sorted = sent[np.lexsort((sent, group))]
        one = order[start]
        of, size = doc[words][one], len(start)
        tf = n.astype(np.float64)
        cased = np.maximum(np.bincount(group, acronym[words], size), np.bincount(group, capital[words], size))
        middle = (sent_sorted[start + (n - 1) // 2] + sent_sorted[start + n // 2]) / 2
        beside = []
        for x in (left, right):
            there = x < none
            met = np.bincount(group[there], minlength=size)
            beside.append(np.where(met > 0, distinct(group[there], x[there], size) / np.maximum(met, 1), 0.0))
        in_document = np.bincount(of, minlength=documents)
        many, most = np.maximum(in_document, 1), np.zeros(documents)
        np.maximum.at(most, of, tf)
        mean = np.bincount(of, tf, documents) / many
        sd = np.sqrt(np.maximum(0.0, np.bincount(of, tf * tf, documents) / many - mean * mean))
        with np.errstate(divide="ignore", invalid="ignore"):
            rel, spread = 1.0 + (beside[0] + beside[1]) * tf / most[of], distinct(group, sent, size) / sentences[of]
            place = np.log(np.log(3.0 + middle))
            s = rel * place / (cased / (1.0 + np.log(tf)) + tf / (mean + sd)[of] / rel + spread / rel)
            raw = s / (tf * (1.0 + s))
            score = np.where(raw > 0, 1.0 / raw, 0.0)
        last = best(of, first["terms"], -score)
        least = np.full(documents, -np.inf)
        full = in_document >= first["terms"]
        if len(last):
            lowest = np.full(documents, np.inf)
            np.minimum.at(lowest, of[last], score[last])
            least[full] = lowest[full] - ROUNDED
        kept = np.flatnonzero(~(score < least[of]))
        kept = kept[np.argsort(of[kept], kind="stable")]
        return lists(of[kept], documents, term=lower.texts(code[one][kept]), score=pa.array(score[kept]))

    def run(lang: pa.Array, column: pa.Array, sentences: pa.Array) -> pa.Array:
        docs = Batch(column)
        inner = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column.flatten().field("toks")), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        ends = inner[docs.offsets]
        known = pc.fill_null(sentences.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        out, a = [], 0
        while a < len(column) or not out:
            b = min(len(column), max(a + 1, int(np.searchsorted(ends, ends[a] + HELD_TOKENS, "right")) - 1))
            out.append(of_lot(lang.slice(a, b - a), column.slice(a, b - a), known[a:b]))
            a = b
        return pa.concat_arrays(out)

    return run
