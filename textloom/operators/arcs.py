"""Heads and labels of many sentences at once: a batch of sentences is one flat array of tags, with the place where each sentence starts.

Helpers of ``trees`` that run in the tasks. Every step is an operation on whole arrays, so its cost grows with the tokens, however long a sentence is.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from textloom.lexicons import UD_RELATIONS as _RELATIONS

# Task functions of this module travel with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTENT = ("NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM", "SYM")
NOMINAL = ("NOUN", "PROPN", "PRON", "ADJ", "NUM")
RELATIONS = dict(_RELATIONS)
#: Labels of the baseline by tag; nouns, adposition objects, predicates and the root are told by their place.
LABELS = {"ADP": "prep", "DET": "det", "AUX": "aux", "PRON": "nsubj", "CCONJ": "cc", "SCONJ": "mark", "PUNCT": "punct", "ADJ": "amod", "ADV": "advmod",
          "NUM": "nummod", "VERB": "conj"}
ARCS = "struct<dep:array<string>,head:array<int>>"
TREE = ("head_basic", "deprel_basic", "head_pp", "deprel_pp", "head_idx", "deprel")
TREES = "struct<" + ",".join(f"{name}:array<{'int' if name.startswith('head') else 'string'}>" for name in TREE) + ">"


class Batch:
    """Sentences of a list column: the flat values, and for each value its sentence and that sentence's start and end."""

    def __init__(self, column: pa.Array):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.n = int(self.offsets[-1])
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.start, self.end = self.offsets[self.of], self.offsets[self.of + 1]
        self.at = np.arange(self.n) - self.start

    def lists(self, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), values)

    def numbers(self, values: np.ndarray) -> pa.Array:
        return self.lists(pa.array(values.astype(np.int32)))

    def first(self, test: np.ndarray) -> np.ndarray:
        """For each sentence the place of its first value that passes, -1 if there is none."""
        out = np.full(len(self.offsets) - 1, -1)
        hits = np.flatnonzero(test)[::-1]
        out[self.of[hits]] = hits  # of several assignments the last one stays
        return out


class Names:
    """A text column as numbers of its distinct values, with further names that results may need."""

    def __init__(self, column: pa.Array, *more: str):
        found = column.dictionary_encode()
        self.names = found.dictionary.to_pylist()
        self.codes = pc.fill_null(found.indices.cast(pa.int64()), len(self.names)).to_numpy(zero_copy_only=False)
        self.names += [None, *more]

    def isin(self, *wanted: str) -> np.ndarray:
        return np.array([n in wanted for n in self.names], bool)[self.codes]

    def code(self, name: str) -> int:
        return len(self.names) - 1 - self.names[::-1].index(name)


def baseline(upos: pa.Array) -> pa.Array:
    """Labels and heads by the adjacency baseline (``trees.with_baseline``)."""
    b, tag = Batch(upos), Names(upos.flatten())
    place, content, adp, aux = np.arange(b.n), tag.isin(*CONTENT), tag.isin("ADP"), tag.isin("AUX")
    roots = np.where((v := b.first(tag.isin("VERB", "AUX"))) >= 0, v, np.where((c := b.first(content)) >= 0, c, b.offsets[:-1]))
    root = roots[b.of]
    behind = np.append(np.minimum.accumulate(np.where(content, place, b.n)[::-1])[::-1], b.n)[1:]
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(content, place, -1))))[:-1]
    forward, back = np.where(behind < b.end, behind, root), np.where(before >= b.start, before, root)
    inside = place > b.start
    after_adp, after_aux = inside & np.roll(adp, 1), inside & np.roll(aux, 1) & (place - 1 == root)
    noun = tag.isin("NOUN", "PROPN")
    by_tag = ["dep", "ROOT", "pobj", "attr", "dobj", "nsubj"] + list(LABELS.values())
    label = np.array([by_tag.index(LABELS[n]) if n in LABELS else 0 for n in tag.names])[tag.codes]
    dep = np.select([place == root, adp, content & after_adp, content & after_aux, noun], [1, by_tag.index("prep"), 2, 3, np.where(place > root, 4, 5)], label)
    head = np.select([place == root, adp, content & after_adp, content & after_aux, tag.isin("DET", "AUX", "PRON", "CCONJ", "SCONJ", "PART"),
                      noun | tag.isin("VERB")], [place, back, place - 1, root, forward, root], back)
    return pa.StructArray.from_arrays([b.lists(pa.array(by_tag).take(pa.array(dep))), b.numbers(head - b.start)], names=["dep", "head"])


def tree(upos: pa.Array, dep: pa.Array, head: pa.Array) -> pa.Array:
    """Numbers and relations before and after the repairs (``trees.with_tree``)."""
    b, tag, label = Batch(upos), Names(upos.flatten()), Names(dep.flatten())
    heads = head.flatten()
    known = heads.is_valid().to_numpy(zero_copy_only=False)
    h = pc.fill_null(heads, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    to = np.where(known, b.start + h, b.n)  # the extra place behind the last token stands for a missing head
    pobj, is_root, attr = label.isin("pobj"), label.isin("ROOT"), label.isin("attr")
    adp, nominal = np.append(tag.isin("ADP"), False), np.append(tag.isin(*NOMINAL), False)
    grand = np.append(to, b.n)[to]  # where the head itself hangs
    below_nominal = pobj & np.where(adp[to], nominal[grand], nominal[to])
    ud = [None if n is None else RELATIONS.get(n, n.lower()) for n in label.names]
    names = ud + ["nmod", "case", "root", "cop"]
    nmod, case, root_name, cop = range(len(ud), len(names))
    rel = np.where(below_nominal, nmod, label.codes)
    basic = np.where(is_root | ~known, 0, h + 1)
    # The object of an adposition moves up; of several that claim one adposition the last keeps it.
    mover = pobj & adp[to] & (grand < b.n) & (grand != to)
    noun = np.zeros(b.n + 1, np.int64)
    noun[to[mover]] = (b.at + 1)[mover]
    noun = noun[:-1]
    claimed = (noun > 0) & (~mover | (noun > b.at + 1))
    mover &= ~claimed
    pp = np.where(claimed, noun, np.where(mover, np.append(b.at, -1)[grand] + 1, basic))
    rel_pp = np.where(claimed, case, np.where(mover, nmod, rel))
    first = b.first(is_root)
    verbal = (first >= 0) & np.append(tag.isin("AUX", "VERB"), False)[first]
    old = np.where(first >= 0, first - b.offsets[:-1] + 1, -1)[b.of]
    new = b.first(attr & known & (to == first[b.of]) & verbal[b.of])
    turned = (new >= 0)[b.of]
    number = np.where(new >= 0, new - b.offsets[:-1] + 1, -1)[b.of]
    is_new, is_old = turned & (b.at + 1 == number), turned & (b.at + 1 == old)
    final = np.where(is_new, 0, np.where(is_old | (turned & (pp == old)), number, pp))
    rel_final = np.where(is_new, root_name, np.where(is_old, cop, rel_pp))
    texts = pa.array(names, pa.string())
    parts = [b.numbers(x) if name.startswith("head") else b.lists(texts.take(pa.array(x)))
             for name, x in zip(TREE, (basic, rel, pp, rel_pp, final, rel_final))]
    return pa.StructArray.from_arrays(parts, names=list(TREE))


def positions(ids: pa.Array, wanted: pa.Array) -> pa.Array:
    """For each list of ids the places (from 0) of the wanted ids in the same list, the first of equal ones; null where an id is missing or absent.

    One sort of all (list, id) of the batch, so a long list costs no more for each entry than a short one.
    """
    b = Batch(ids)
    have, want = ids.flatten().cast(pa.int64()), wanted.flatten().cast(pa.int64())
    known = want.is_valid().to_numpy(zero_copy_only=False)
    plain = [pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (have, want)]
    names, codes = np.unique(np.concatenate(plain), return_inverse=True)
    listed = have.is_valid().to_numpy(zero_copy_only=False)
    key = b.of * len(names) + codes[:b.n]
    place = np.flatnonzero(listed)[np.argsort(key[listed], kind="stable")]
    key, asked = key[place], b.of * len(names) + codes[b.n:]
    at = np.searchsorted(key, asked)
    found = known & (at < len(key))
    found[found] = key[at[found]] == asked[found]
    out = np.zeros(b.n, np.int32)
    out[found] = b.at[place[at[found]]]
    return b.lists(pa.array(out, mask=~found))


def starts(sizes: pa.Array) -> pa.Array:
    """For each list of sizes the sums of those before."""
    b = Batch(sizes)
    sums = np.concatenate(([0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
    return b.numbers(sums[:-1] - sums[b.start])
