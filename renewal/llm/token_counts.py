"""Token counts of whole texts under a unigram model, by dynamic programming on a shared trie.

Pre-tokens are the words of a text (runs of anything but ASCII white space), each with one
space before it.  The distinct pre-tokens of a block of texts make a trie, built level by level
from their sorted bytes.  A trie node holds the best score of segmenting the bytes on its path
(and that segmentation's token count), computed once from its parent however many pre-tokens
pass through it.  The count at a pre-token's last node is stored, so a document's count is a
sum of stored counts.

The vocabulary is a public rank file of byte pieces.  Its ranks give the unigram scores by
Zipf's law, ``-log(rank + 2.7)``; every single byte is a piece, so each word has a
segmentation.  The best segmentation has the highest score, then the fewest tokens.

Defined results: a null or empty text has 0 pre-tokens and 0 tokens; the result has a row per
input row; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.llm.tokens import tokenizer_path

#: Pre-tokens whose counts a worker remembers, and texts handled at once (memory bounds).
CACHE_WORDS, TEXTS = 2_000_000, 1000
COUNTED = "doc_id long, n_pretokens long, n_tokens long, score double"


def load_pieces(name: str) -> dict[bytes, float]:
    """Byte pieces of a rank file with their unigram log-scores."""
    with open(tokenizer_path(name), "rb") as f:
        return {base64.b64decode(a): -math.log(int(r) + 2.7) for a, r in (line.split() for line in f if line.strip())}


class UnigramTrie:
    """Best segmentations of many words, worked out level by level on the trie of their bytes."""

    def __init__(self, pieces: dict[bytes, float]):
        # the vocabulary's own trie: step[row[state], byte] is the next state, 0 for none; state 1 is its root
        states: list[dict[int, int]] = [{}, {}]
        scores = [math.nan, math.nan]
        for piece, score in pieces.items():
            at = 1
            for b in piece:
                if b not in states[at]:
                    states[at][b] = len(states)
                    states.append({})
                    scores.append(math.nan)
                at = states[at][b]
            scores[at] = score
        inner = [i for i, n in enumerate(states) if n]
        self.row = np.zeros(len(states), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.step = np.zeros((len(inner) + 1, 256), np.int32)
        for k, i in enumerate(inner, 1):
            self.step[k, list(states[i])] = list(states[i].values())
        self.score = np.array(scores)

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, scores) of the best segmentations of sorted distinct words."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        count, total = np.zeros(len(words), np.int64), np.zeros(len(words))
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # words still going on, and their trie nodes
        best, tokens = np.zeros(1), np.zeros(1, np.int64)  # per node of the last level
        # pieces begun but not ended, by node: vocabulary state, and score and tokens where they began
        owner, state, base, used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)
        depth = 0
        while True:
            done = size[word] == depth
            count[word[done]], total[word[done]] = tokens[node[done]], best[node[done]]
            word, node = word[~done], node[~done]
            if not len(word):
                return count, total
            byte = flat[first[word] + depth]
            new = np.r_[True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])]  # shared prefixes become one node
            parent, label = node[new], byte[new]
            node = np.cumsum(new) - 1
            begun = np.bincount(owner, minlength=len(best))
            at = np.cumsum(begun) - begun
            n = begun[parent] + 1  # what the parent has begun, and a piece that begins here
            child = np.repeat(np.arange(len(parent)), n)
            place = np.arange(len(child)) - np.repeat(np.cumsum(n) - n, n)
            own = place == begun[parent][child]
            old = np.where(own, 0, at[parent][child] + place)
            if not len(state):
                old, state, base, used = np.zeros(len(child), np.int64), np.ones(1, np.int32), np.zeros(1), np.zeros(1, np.int64)
            state = self.step[self.row[np.where(own, 1, state[old])], label[child]]
            base = np.where(own, best[parent][child], base[old])
            used = np.where(own, tokens[parent][child], used[old])
            value = np.where(state > 0, base + self.score[state], math.nan)
            value[np.isnan(value)] = -math.inf
            starts = np.cumsum(n) - n
            best = np.maximum.reduceat(value, starts)
            tokens = np.minimum.reduceat(np.where(value == best[child], used + 1, np.iinfo(np.int64).max), starts)
            alive = self.row[state] > 0
            owner, state, base, used = child[alive], state[alive], base[alive], used[alive]
            depth += 1


_tries: dict[str, tuple[UnigramTrie, dict[str, tuple[int, float]]]] = {}


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens, score (natural log of the best segmentations)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _tries:
            _tries[vocabulary] = (UnigramTrie(load_pieces(vocabulary)), {})
        trie, known = _tries[vocabulary]
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                some = batch.slice(i, TEXTS)
                words = pc.ascii_split_whitespace(pc.fill_null(some.column("text").cast(pa.large_string()), ""))
                coded = words.flatten().dictionary_encode()
                keys = coded.dictionary.to_pylist()
                if len(known) + len(keys) > CACHE_WORDS:
                    known.clear()
                fresh = sorted(b" " + k.encode("utf-8") for k in keys if k and k not in known)
                if fresh:
                    for k, n, score in zip(fresh, *(x.tolist() for x in trie.counts(fresh)), strict=True):
                        known[k[1:].decode("utf-8")] = (n, score)
                known[""] = (0, 0.0)
                found = [known[k] for k in keys]
                code = coded.indices.to_numpy(zero_copy_only=False)
                size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(some)), size)
                each = [(int(k != ""), c, v) for k, (c, v) in zip(keys, found, strict=True)]
                values = np.array(each, float).reshape(-1, 3)[code]
                sums = [np.bincount(doc, values[:, j], len(some)) for j in range(3)]
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "n_pretokens": sums[0].astype(np.int64), "n_tokens": sums[1].astype(np.int64), "score": sums[2]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, COUNTED)
