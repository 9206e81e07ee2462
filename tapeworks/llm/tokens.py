"""Token ids of whole texts, with the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np

from .common import claim, keeps
from .words import MEMO_ENTRIES

#: Longer words aren't kept after their batch.
LONGEST = 60

_loaded: dict[str, Encoder] = {}
keeps("tokens", _loaded.clear)


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts as little-endian uint32 ids, as the library does without adding special tokens.

    A byte-level tokenizer cuts a text before every space that follows no space and at single line
    ends, so there the ids of a word with its space don't depend on what surrounds it. Those are looked
    up in bounded tables and only words that they lack go to the library, many in one text.
    Texts with white space in a row or a string of one of the tokenizer's added tokens go to the library whole, as do
    all texts of other kinds of tokenizers.
    """

    _runs = re.compile(r"[ \n](?:\s|\Z)").search

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        # words after a space and at the start of a line; of each, the table in use and the one before it
        self.tables: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {" ": ({}, {}), "\n": ({}, {})}
        self.tails: dict[str, bytes] = {}
        self.line_end = self._library(["\n"])[0]
        # whether an id's piece of text begins with a space, or is a line end: byte-level tokenizers write them as these letters
        pieces = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.opens = {" ": np.array([p.startswith("\u0120") for p in pieces]), "\n": np.array([p == "\u010a" for p in pieces])}

    def _library(self, texts: list[str]) -> list[bytes]:
        # the fast one leaves out offsets, not ids
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters only, each after a space or a line end, from one text."""
        ids = self._library([before + before.join(words)])[0]
        at = np.flatnonzero(self.opens[before][np.frombuffer(ids, "<u4")]) if self.by_word else ()
        if len(at) != len(words) or at[0] != 0:
            return self._library([before.strip("\n") + w for w in words])
        begin = at + (before == "\n")  # a line end is an id of its own
        return [ids[a:b] for a, b in zip((4 * begin).tolist(), (4 * np.append(at[1:], len(ids) // 4)).tolist())]

    def _learn(self, words: set[str], before: str) -> tuple[dict[str, bytes], list[str]]:
        """The table with all these words, and which of them are too long to be kept in it."""
        table, old = self.tables[before]
        if len(table) > MEMO_ENTRIES:
            table, old = {}, table
            self.tables[before] = table, old
        new = words.difference(table)
        if old:
            again = [w for w in new if w in old]
            table.update((w, old[w]) for w in again)
            new.difference_update(again)
        plain = set(filter(str.isalpha, new))
        ends, odd = {}, []
        for w in new.difference(plain):
            core = w.rstrip(string.punctuation)
            if core.isalpha():
                ends[w] = core
                if core not in table:
                    plain.add(core)
            else:
                odd.append(w)
        long = [w for w in [*new, *plain] if len(w) > LONGEST]
        new = list(plain)
        for i in range(0, len(new), 4000):
            table.update(zip(new[i : i + 4000], self._letters(new[i : i + 4000], before)))
        for w, core in ends.items():
            tail = w[len(core) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._library([tail])[0]
            table[w] = table[core] + self.tails[tail]
        table.update(zip(odd, self._library([before.strip("\n") + w for w in odd])))
        return table, long

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole, lines, heads, rest = [], {}, set(), set()
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif not self.by_word or self._runs(text) or any(a in text for a in self.added):
                whole.append(i)
            else:
                lines[i] = cut = [line.split(" ") for line in text.split("\n")]
                heads.update([ws[0] for ws in cut])
                rest.update(*cut)
        (first, long_heads), (known, long_rest) = self._learn(heads, "\n"), self._learn(rest, " ")
        find = known.__getitem__
        for i, cut in lines.items():
            out[i] = self.line_end.join([first[ws.pop(0)] + b"".join(map(find, ws)) for ws in cut])
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        for table, long in ((known, long_rest), (first, long_heads)):
            for w in long:
                table.pop(w, None)
        return out


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by each Python worker."""
    claim("tokens")
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
