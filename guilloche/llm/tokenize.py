"""Tokenizer encoding inside tasks, with a cache of white-space separated chunks.

Neither pre-tokenizer in use joins anything across the chunks cut here, so that a text's ids
are its chunks' ids in a row. The tokenizers library encodes each distinct chunk once while
the bounded cache holds it. Texts with special tokens or with control characters on which
two notions of white space differ are encoded whole, as are all texts of a tokenizer whose
pre-tokenizer is not known to keep chunks apart.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

#: A blank belongs to what follows it; a longer run of white space leaves its last character over.
_BLANK_FIRST = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that only some count as white space, and the mark below.
_ODD = re.compile("[\\x01\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")
#: White space other than blank and line feed.
_RARE = re.compile("[\\t\\r\\x0b\\x0c\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_CACHE_CHUNKS = 1_000_000
_encoders: dict[str, "Encoder"] = {}


class _Cache(dict):
    """Ids by chunk; a chunk that it has not seen is noted, and has None for now."""

    def __init__(self, items=()):
        super().__init__(items)
        self.missing: list[str] = []

    def __missing__(self, chunk: str) -> None:
        self[chunk] = None
        self.missing.append(chunk)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer") or {})
        self.blank_first = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.separable = self.blank_first or '"\\\\s+"' in normal  # the latter: white space becomes blanks, and splits
        self.mark = "\n" if self.blank_first else " \x01 "
        self.mark_id = self.lib.encode(self.mark.strip(" "), add_special_tokens=False).ids[-1]
        self._line_feed = np.array(self.lib.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.cache = _Cache()  # by chunk; of a byte-level tokenizer with the blank before it
        self.plain = _Cache()  # by chunk as it stands

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str], before: str) -> dict[str, bytes]:
        """Ids of chunks without white space inside: many are encoded as one text, with a mark between them that no chunk contains."""
        out: dict[str, bytes] = {}
        for k in range(0, len(chunks), 1024):
            run = chunks[k : k + 1024]
            ids = np.array(self.lib.encode_batch_fast([before + (self.mark + before).join(run)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id) * 4
            if len(ends) != len(run) - 1:
                raise ValueError("the tokenizer joins what the mark separates")
            data, a = ids.tobytes(), 0
            for c, b in zip(run, [*ends.tolist(), len(data)]):
                out[c], a = data[a:b], b + 4
        return out

    def _chunks(self, chunks: list[str], before: str) -> dict[str, bytes]:
        """Ids of each chunk with ``before`` in front of it; one that starts with a line feed has nothing else there."""
        blank = [c for c in chunks if not c or c.isspace()]
        out = dict(zip(blank, self._library([c if c[:1] == "\n" else before + c for c in blank])))
        rest = [c for c in chunks if c not in out]
        starts = [c[1:] for c in rest if c[0] == "\n"]
        out.update(("\n" + c, self._line_feed + ids) for c, ids in self._joined(starts, "").items())
        return out | self._joined([c for c in rest if c[0] != "\n"], before)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text counts as empty."""
        texts = [t or "" for t in texts]
        if not self.separable:
            return self._library(texts)
        out: list = [b""] * len(texts)
        lead, plain = [], []  # (index, chunks, ids of the chunks that are known)
        get, at = self.cache.__getitem__, self.plain.__getitem__
        for i, t in enumerate(texts):
            common = t.replace("\n", "").isprintable()  # no white space but blanks and line feeds, no control characters
            if not common and _ODD.search(t) or any(s in t for s in self.special):
                out[i] = self._library([t])[0]
            elif not self.blank_first:
                lead.append((i, c := t.split(), list(map(get, c))))
            elif "  " in t or "\n " in t or " \n" in t or "\n\n" in t or not common and _RARE.search(t):
                plain.append((i, c := _BLANK_FIRST.findall(t), list(map(at, c))))
            else:  # a chunk at the start of a line has the line feed before it, the first one for the while
                c = t.replace("\n", " \n").split(" ")
                c[0] = "\n" + c[0]
                lead.append((i, c, list(map(get, c))))
        for cache, rows, before in ((self.plain, plain, ""), (self.cache, lead, " " if self.blank_first else "")):
            cache.update(self._chunks(cache.missing, before))
            cache.missing.clear()
            for i, chunks, ids in rows:
                k = -1
                for _ in range(ids.count(None)):
                    k = ids.index(None, k + 1)
                    ids[k] = cache[chunks[k]]
                out[i] = b"".join(ids)[4 * (before == " ") :]
        for name in ("plain", "cache"):
            if len(old := getattr(self, name)) > _CACHE_CHUNKS:  # what was seen first is what is seen most
                setattr(self, name, _Cache(islice(old.items(), _CACHE_CHUNKS // 2)))
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
