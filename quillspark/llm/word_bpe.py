"""Byte-pair encoding with word ends, and its decoding.

An input text goes through the steps that the vocabulary file lists: special
strings are cut out, the rest is brought to NFC, white space becomes one space,
letters become small, and a pattern cuts pre-tokens.  A file that lists other steps
is refused.  Each pre-token's symbols
are merged with a segment tree over the ranks of adjacent pairs: the root names
the leftmost pair of the lowest rank, and a merge is three point updates of
logarithmic cost, until no pair can be merged.  Pre-tokens that come again are
taken from a bounded cache in the worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from sys import getsizeof

import regex

#: White space and the pre-token pattern as the vocabulary's library reads them.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"
WORD_END = "</w>"
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_pairs(symbols: list[int], rank_of: dict[int, int], made_by: list[int]) -> list[int]:
    """Merges ``symbols`` to the end.

    ``rank_of`` maps ``left << 20 | right`` to a rank, ``made_by`` a rank to the
    merged symbol.  A leaf holds ``rank * n + place``, so that the smallest value
    is the leftmost of the lowest rank.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get = rank_of.get
    width = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        r = get(symbols[i] << 20 | symbols[i + 1])
        if r is not None:
            tree[width + i] = r * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    top = tree[1]
    while top != _NONE:
        rank, i = divmod(top, n)
        gone = after[i]
        right = after[gone]
        symbols[i] = made = made_by[rank]
        after[i] = right
        if right < n:
            before[right] = i
            r = get(made << 20 | symbols[right])
            changes = [(i, _NONE if r is None else r * n + i)]
        else:
            changes = [(i, _NONE)]
        if gone < n - 1:
            changes.append((gone, _NONE))
        left = before[i]
        if left >= 0:
            r = get(symbols[left] << 20 | made)
            changes.append((left, _NONE if r is None else r * n + left))
        for at, value in changes:
            at += width
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                least = value if value < other else other
                if tree[at] == least:
                    break
                tree[at] = value = least
        top = tree[1]
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


#: The first code point that is unassigned, and all beyond.
_FAR = re.compile(f"[{chr(0x378)}-{chr(0x10FFFF)}]")


def _unassigned() -> str:
    """A pattern for one code point that this Python's Unicode version leaves unassigned."""
    spans, last = [], -2
    for c in range(0x378, 0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if c == last + 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
            last = c
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


#: Pre-tokens of more characters are merged anew each time they come.
WORD_CHARS = 64


def cost_of(word: str, ids: tuple = ()) -> int:
    """About the bytes that a kept pre-token takes."""
    return getsizeof(word) + getsizeof(ids) + 100


class _Words(dict):
    """Pre-token to ids, for pre-tokens that come again, in bounded memory."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.room = encode, most, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.encode(word)
        if len(word) <= WORD_CHARS:
            self.room -= cost_of(word, out)
            if self.room < 0:
                self.clear()
                self.room = self.most
            self[word] = out
        return out


#: The steps that this encoder takes.  A file that lists others is refused.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PRE_TOKEN.replace(WHITE, r"\s")}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": WORD_END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def check_steps(spec: dict) -> None:
    """Raises unless the file's steps are those of this encoder."""
    odd = [k for k, v in _STEPS.items() if spec.get(k) != v] + [f"model.{k}" for k, v in _MODEL.items() if spec["model"].get(k) != v]
    odd += ["added_tokens" for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if odd:
        raise ValueError(f"the vocabulary file takes steps that this encoder doesn't: {', '.join(odd)}")


class WordBpe:
    """Encoder and decoder of one vocabulary file (``.json``) with the steps of :data:`_STEPS`."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20):
        self.path, self.odd, self.library = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_steps(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank_of, self.made_by = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.rank_of[vocab[a] << 20 | vocab[b]] = rank
            self.made_by.append(vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + WORD_END] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.words = _Words(self.encode_word, cache_bytes)

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        return tuple(merge_pairs(symbols, self.rank_of, self.made_by))

    def parts(self, text: str) -> list[tuple[int | None, list[str]]]:
        """The text's special ids (with no words) and runs of pre-tokens, in order."""
        pieces = self.cut.split(text) if any(special in text for special in self.special) else [text]
        out: list[tuple[int | None, list[str]]] = []
        for piece in pieces:
            if piece in self.special:
                out.append((self.special[piece], []))
            elif piece:
                out.append((None, self.pre_tokens(piece)))
        return out

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a text without special strings.

        Unicode versions differ only in code points that Python holds unassigned;
        a text with such a one is cut by the library itself.
        """
        if not piece.isascii() and _FAR.search(piece):
            if self.odd is None:
                self.odd = re.compile(_unassigned())
            if self.odd.search(piece):
                return self._pre_tokens_by_library(piece)
        return self.find(normal(piece))

    def _pre_tokens_by_library(self, piece: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        runs = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(self.byte_of[c] for c in word).decode() for word, _ in runs]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end tokens; special strings give their own ids."""
        ids: list[int] = []
        words = self.words
        for special, run in self.parts(text):
            if special is not None:
                ids.append(special)
            for word in run:
                ids += words[word]
        return ids

    def decode(self, ids: list[int]) -> str:
        """What the file's library decodes: it names no decoder, so tokens are joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


def normal(text: str) -> str:
    """NFC and small letters, each letter by itself; white space needs no change, as pre-tokens hold none."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()
