"""Token ids of whole texts from a public tokenizer file, fast on natural word statistics.

A text is cut only where the tokenizer's own pre-tokenizer is sure to cut: before a single
space or line break, and between a letter or digit and a full stop or comma that ends a chunk.  Distinct chunks are encoded once, by the ``tokenizers`` library, and
their ids are reused for every later occurrence (a bounded cache per Python worker).  The
concatenated ids equal those of encoding the whole text at once (tested).  Texts with other
white space or runs of it take the library's plain way.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Chunks a worker remembers before it starts afresh (bounds memory, never results).
CACHE_CHUNKS = 1_000_000
#: Texts handled at once, and chunks given to one library call.
TEXTS, CALL = 2000, 100

#: Texts whose cuts aren't plain: adjacent or outer white space, any white space other than
#: space and line break, a special token's brackets, or the marker of a chunk without a space.
_ODD = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|<\||[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_MARK, _NONE = pa.scalar("\x00", pa.large_string()), pa.scalar("", pa.large_string())
_encoders: dict[str, ChunkEncoder] = {}


def tokenizer_path(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


class ChunkEncoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.sep = "<|endoftext|>"
        self.sep_id = self.tok.token_to_id(self.sep)
        same = lambda c: self.tok.encode(c, add_special_tokens=False).ids == self.tok.encode(c.lower(), add_special_tokens=False).ids
        self.lowers = all(map(same, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        self.cache: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def learn(self, keys: list[str]) -> None:
        """Encode the chunks not seen yet, many to a call, split at a special token."""
        if len(self.cache) + len(keys) > CACHE_CHUNKS:
            self.cache = {}
        new = [k for k in keys if k not in self.cache]
        usual = new if self.sep_id is not None else []
        for i in range(0, len(usual), CALL):
            some = usual[i : i + CALL]
            text = self.sep.join([k[1:] if k[:1] == "\x00" else k if k[:1] == "\n" else " " + k for k in some])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.r_[np.flatnonzero(ids == self.sep_id), len(ids)].tolist()
            raw, at = ids.tobytes(), 0
            for k, e in zip(some, ends, strict=True):
                self.cache[k] = raw[4 * at : 4 * e]
                at = e + 1
        if self.sep_id is None:
            for k in new:
                self.cache[k] = self.plain(k[1:] if k[:1] == "\x00" else k if k[:1] == "\n" else " " + k)

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lowers:
            texts = pc.ascii_lower(texts)
        marked = pc.binary_join_element_wise(_MARK, pc.replace_substring(texts, "\n", " \n"), _NONE)
        marked = pc.replace_substring_regex(marked, r"([\pL\pN])([.,])( |$)", "\\1 \x00\\2\\3")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(keys)
        found = [self.cache[k] for k in keys]
        flat = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = size[code]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[code] - (ends - n), n)]
        per_doc = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        return ids, np.r_[0, ends][per_doc]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin and end (n + 1 places).

        A null text counts as empty and has no ids.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        flats, bounds, total = [], [np.zeros(1, np.int64)], 0
        for i in range(0, len(texts), TEXTS):
            some = texts.slice(i, TEXTS)
            odd = pc.or_(pc.match_substring_regex(some, _ODD), pc.equal(some, "")).to_numpy(zero_copy_only=False)
            ids, at = self._some(some.filter(pa.array(~odd)))
            if odd.any():
                raw, n = [], np.zeros(len(some), np.int64)
                n[~odd] = np.diff(at)
                usual = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
                for j, is_odd in enumerate(odd):
                    raw.append(np.frombuffer(self.plain(some[j].as_py()), np.uint32) if is_odd else next(usual))
                    n[j] = len(raw[-1])
                ids, at = np.concatenate(raw), np.r_[0, np.cumsum(n)]
            flats.append(ids)
            bounds.append(at[1:] + total)
            total += len(ids)
        return np.concatenate(flats) if flats else np.zeros(0, np.uint32), np.concatenate(bounds)


def encoder(name: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file (a name in the public set, or a path)."""
    path = tokenizer_path(name)
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
