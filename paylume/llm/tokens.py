"""Token ids of whole texts by the file of a byte-level BPE tokenizer, at bounded memory.

Such tokenizers begin a new piece between letters and punctuation and at each single space or line end between other
characters. Texts of plain form are therefore cut at these places, and a worker remembers the ids of the pieces it has
met. Any other text is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

#: Pieces whose token ids a worker remembers; beyond it, the memory starts anew.
MEMO = 1_000_000
_W = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: Pieces of plain texts: words with inner apostrophes, other characters, each with the space before it; line ends.
PIECES = re.compile(rf" ?[{_W}]+(?:'[{_W}]+)*| ?[^{_W} \n']+|\n")
#: What makes a text other than plain: letters beyond Latin-1 and white space but single spaces and line ends between
#: others; apostrophes at the end of words.
ODD = re.compile(r"[^\x00-\x08\n\x0e-\x1b\x20-\x7FÀ-ÖØ-öø-ÿ]")
ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
ODD_APOSTROPHE = re.compile(rf"(?<![{_W}])'|'(?![{_W}])")
#: The pieces of byte-level BPE (fixed value, as published with the vocabulary).
BPE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable, else
    the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged_by_rank(path: str):
    """An encoder by ranks for a byte-level BPE file whose merges are in the order of their ids, which gives the same
    ids several times as fast; None for any other file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(set(made)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte = byte_alphabet()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=BPE_PIECES, mergeable_ranks=ranks, special_tokens={})


class Memo(dict):
    """Ids of pieces, encoded when they are first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", self.encode(piece)).tobytes()
        return ids


class TokenIds:
    """Encodes texts to little-endian 32-bit ids, as the tokenizer of the file does without adding special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = merged_by_rank(path)
        self.known = Memo(self.ranked.encode_ordinary) if self.ranked is not None else None

    def whole(self, text: str) -> bytes:
        if self.ranked is not None and not any(s in text for s in self.special):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        if self.known is None or any(s in text for s in self.special) or ODD.search(text) or ODD_SPACE.search(text) or ("'" in text and ODD_APOSTROPHE.search(text)):
            return self.whole(text)
        if len(self.known) > MEMO:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, PIECES.findall(text)))


_of: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """The worker's encoder of a file, kept between its tasks."""
    if path not in _of:
        _of[path] = TokenIds(path)
    return _of[path]
