"""Encoding of whole texts with the tokenizers library, each distinct word once.

The split pattern of these vocabularies starts a new pre-token at a space, unless
more white space comes before and after it, and byte-level BPE never merges
across pre-tokens.  So a text is cut in front of its spaces, the distinct parts
of a batch are found by Arrow, only those not met lately are encoded, and the
ids of the texts are gathered from theirs.  Parts without other white space are
encoded many at a time, a line each: a line break is a pre-token and an id of its own there.  A text with a space inside a run of
white space is encoded whole, and so is every text where a vocabulary splits
in another way or normalises texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

TOKENIZER = "byte_bpe_50k.json"
#: White space in the sense of the split pattern, and a space inside or at the end of a run of it.
_W = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INSIDE = rf"{_W} (?:{_W}|\z)"
#: A part without white space but a space before it.
_PLAIN = rf"\A ?[^{_W[1:]}+\z"
#: Parts remembered in a worker; the memo is emptied beyond that.
BOUND = 2_000_000
#: Parts whose ids are gathered at once, parts encoded at once, and parts that are lines of one text.
GATHERED, ENCODED, JOINED = 100_000, 2000, 200
_BYTES = methodcaller("encode", "utf-8", "surrogatepass")


class Memo:
    """Ids of parts by the 128-bit hash of a part, in flat arrays: some 30 bytes an entry."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.uint16)
        self.blob, self.used = np.empty(1 << 16, dtype), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys[:, 0]), len(self.keys) - 1)
        known = (self.keys[at] == keys[:, 0]) & (self.check[at] == keys[:, 1])
        return np.where(known, self.starts[at], 0), np.where(known, self.sizes[at], 0).astype(np.int64), known

    def put(self, ids: np.ndarray) -> int:
        first, end = self.used, self.used + len(ids)
        if end > len(self.blob):
            self.blob = np.concatenate([self.blob[:first], np.empty(max(end, len(self.blob)), self.blob.dtype)])
        self.blob[first:end], self.used = ids, end
        return first

    def learn(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Very long parts aren't remembered, nor is a part whose first 64 bits are another's."""
        first, one = np.unique(keys[:, 0], return_index=True)
        at = np.searchsorted(self.keys, first)
        free = sizes[one] < 1 << 16
        if len(self.keys):
            free &= self.keys[np.minimum(at, len(self.keys) - 1)] != first
        one, at = one[free], at[free]
        self.keys, self.check = np.insert(self.keys, at, keys[one, 0]), np.insert(self.check, at, keys[one, 1])
        self.starts, self.sizes = np.insert(self.starts, at, starts[one]), np.insert(self.sizes, at, sizes[one].astype(np.uint16))


class Encoder:
    """Texts to little-endian id strings, ``width`` bytes an id.

    ``tokenizer``: a path, or the name of a public vocabulary file.
    """

    def __init__(self, tokenizer: str = TOKENIZER, bound: int = BOUND):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.library = Tokenizer.from_file(tokenizer)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.width, self.bound = self.dtype.itemsize, bound
        self.memo = Memo(self.dtype)
        made = json.loads(self.library.to_str())
        split = made.get("pre_tokenizer") or {}
        plain = made.get("normalizer") is None and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in made.get("added_tokens", []))
        #: Whether texts may be cut in front of spaces.
        self.cuts = plain and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")
        broken = self.library.encode("\n", add_special_tokens=False).ids
        bare = made.get("truncation") is None and made.get("padding") is None and not any(c.isspace() for t in made.get("added_tokens", []) for c in t["content"])
        #: The id of a line break, if parts may be encoded as lines.
        self.line = broken[0] if self.cuts and bare and len(broken) == 1 else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=self.dtype, count=int(sizes.sum())), sizes

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first place in the blob, number of ids) of each part."""
        memo, n = self.memo, len(parts)
        raw = b"".join(map(xxhash.xxh3_128_digest, map(_BYTES, parts)))
        keys = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
        starts, sizes, known = memo.find(keys)
        new = np.flatnonzero(~known)
        if len(new) + len(memo.keys) > self.bound:
            memo = self.memo = Memo(self.dtype)
            starts, sizes, new = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        alone = new
        if self.line is not None and len(new):
            plain = pc.match_substring_regex(pa.array([parts[i] for i in new.tolist()], pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
            alone, lines = new[~plain], new[plain]
            for at in range(0, len(lines), ENCODED):
                some = lines[at : at + ENCODED]
                own = [parts[i] + "\n" for i in some.tolist()]
                flat = self._flat(["".join(own[i : i + JOINED]) for i in range(0, len(own), JOINED)])[0]
                ends = np.flatnonzero(flat == self.line)
                if len(ends) != len(own):
                    alone = np.concatenate([alone, some])
                    continue
                sizes[some] = np.diff(ends, prepend=-1) - 1
                starts[some] = memo.put(flat[flat != self.line]) + np.cumsum(sizes[some]) - sizes[some]
        for at in range(0, len(alone), ENCODED):
            some = alone[at : at + ENCODED]
            flat, sizes[some] = self._flat([parts[i] for i in some.tolist()])
            starts[some] = memo.put(flat) + np.cumsum(sizes[some]) - sizes[some]
        memo.learn(keys[new], starts[new], sizes[new])
        return starts, sizes

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        column = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        if not len(column):
            return []
        if not self.cuts:
            return self._whole(column.to_pylist())
        odd = pc.match_substring_regex(column, _INSIDE)
        split = pc.split_pattern(pc.if_else(odd, "", column), " ")
        words = split.flatten().dictionary_encode()
        codes, names = words.indices.to_numpy().copy(), words.dictionary.to_pylist()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        del split, words  # as large as the texts
        # The first part of a text has no space before it.
        lead, place = np.unique(codes[bounds[:-1]], return_inverse=True)
        codes[bounds[:-1]] = len(names) + place
        first = [names[i] for i in lead.tolist()]
        for i, n in enumerate(names):
            names[i] = " " + n
        starts, sizes = self._parts(names + first)
        del names, first
        flat, lengths = self.memo.blob, sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        gathered = np.empty(ends[-1], self.dtype)
        for at in range(0, len(codes), GATHERED):
            part = slice(at, at + GATHERED)
            a, b = ends[at], ends[min(at + GATHERED, len(codes))]
            gathered[a:b] = flat[np.arange(a, b) + np.repeat(starts[codes[part]] - ends[:-1][part], lengths[part])]
        cuts = ends[bounds].tolist()
        out = [gathered[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if at:
            for i, found in zip(at, self._whole(column.take(pa.array(at)).to_pylist()), strict=True):
                out[i] = found
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One encoder a worker process."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]
