"""Pre-tokens and ids of a BPE vocabulary with word ends, exactly as the tokenizers library gives them.

Text of plain Latin letters takes a compiled pattern; any other text goes through the library's own
normaliser and pre-tokenizer. The merges always come from the library's model, once per distinct pre-token.
"""

from __future__ import annotations

import re
import struct

KEPT = 150_000  # pre-tokens whose ids a worker's cache holds
# Outside these sets normalisation or character classes may differ between libraries.
PLAIN = b"\t\n\r" + bytes(range(32, 127))
UNSAFE = re.compile(r"[^\t\n\r -~¡-įı-ſ]")
LOWER = "a-zªµºß-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
PACK = [struct.Struct(f"<{n}I").pack for n in range(20)]
PIECE = re.compile(rf"[{LOWER}]+|[{NUMBER}]|'(?:[stmd]|re|ve|ll)|[^\s{LOWER}{NUMBER}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer_path(name: str, path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def plain(text: str) -> bool:
    """Whether PIECE splits the text as the library does."""
    if "<|" in text:
        return False
    return not text.encode().translate(None, PLAIN) if text.isascii() else not UNSAFE.search(text)


class Cached(dict):
    """Values by key, made on first use; emptied when it holds too many."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Recent(dict):
    """Values by key, made on first use. When half of `most` are held, they become the older half in place of the one
    before, and what is used again comes back from there, so that rare keys do not drive out frequent ones."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    cache = Recent

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json", path))
        self.model = self.library.model
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens in order; a special token's string stands for itself."""
        if plain(text):
            return PIECE.findall(text.lower())
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(self.bytes[c] for c in mapped).decode())
        return out

    def ids(self, pretoken: str) -> list[int]:
        if pretoken in self.special:
            return [self.special[pretoken]]
        if not (pretoken.isascii() and pretoken.isprintable() and " " not in pretoken):  # such letters stand for themselves
            pretoken = pretoken.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(pretoken)]


def packed(ids: list[int]) -> bytes:
    return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict = {}


def loaded(kind, path: str | None, most: int = KEPT):
    """One tokenizer and one cache of ids for each Python worker: (tokenizer, cache of little-endian uint32 ids)."""
    key = (kind, path)
    if key not in _loaded:
        tok = kind(path)
        _loaded[key] = tok, getattr(kind, "cache", Cached)(lambda p: packed(tok.ids(p)), most)
    return _loaded[key]

