"""Token ids of a byte-level BPE vocabulary, cached by pre-token.

The vocabulary is that of a public tokenizer file; its path is a parameter. Texts whose characters all lie below U+0250
are cut into pre-tokens with array operations, and the ids of a pre-token are looked up in a bounded cache; texts with
apostrophes (contractions), special tokens' strings or other characters go through the tokenizer's own splitter. The ids
are the same either way, and those of the `tokenizers` library, which tests hold them against; its own encoder takes 1.4 times the
time with the same cache, so the merges are done by another library from the same file's vocabulary.
"""

from __future__ import annotations

import json

import numpy as np

CACHE_ENTRIES = 400_000
_NARROW = 0x250
#: White space below U+0250 as the splitter's pattern has it.
_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    import regex

    out = np.full(_NARROW, 2, np.uint8)
    for c in range(_NARROW):
        if c in _SPACE:
            out[c] = 3
        elif regex.match(r"\p{L}", chr(c)):
            out[c] = 0
        elif regex.match(r"\p{N}", chr(c)):
            out[c] = 1
    return out


def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of byte strings, and of special tokens, from a `tokenizers` file. Its tokens stand for bytes by characters: printable
    ones of Latin-1 for themselves, the others, in order, by those from U+0100 on."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(c): c for c in plain} | {chr(0x100 + k): c for k, c in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}, special


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[piece] = np.asarray(self.encode(piece.encode("utf-8")), np.uint16).tobytes()
        return out


class Tokens:
    """ids(text) gives the ids as uint16."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        ranks, special = _vocabulary(path or default_path())
        if max(*ranks.values(), *special.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.classes = tuple(special), _classes()
        self.pieces = _Pieces(self.encoding._core_bpe.encode_single_piece)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint16)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.max() >= _NARROW or "'" in text or any(s in text for s in self.special):
            return np.asarray(self.encoding.encode(text, allowed_special="all"), np.uint16)
        kind = self.classes[codes]
        starts = np.empty(len(kind), bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        first = np.flatnonzero(starts)
        space = kind[first] == 3
        before = first[1:][space[:-1]] - 1  # the last white space before each further run
        starts[before] = True
        joined = first[1:][~space[1:]]
        starts[joined[codes[joined - 1] == 32]] = False
        at = np.flatnonzero(starts).tolist()
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)])), np.uint16)
