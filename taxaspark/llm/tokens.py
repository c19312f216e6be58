"""Token ids of whole texts by a public tokenizer, remembered by piece."""

from array import array

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
KEPT_PIECES = 750_000
PUNCTUATION = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"  # ASCII, without quotes, which start contractions


def _byte_letters():
    """Byte value to the character a byte-level vocabulary writes for it (fixed by that format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


BYTE_LETTERS = _byte_letters()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``ids(text)`` as the tokenizers library gives them, without special tokens.

    A byte-level BPE never joins across a single blank between two characters
    that are not white space, nor across a single line end between two such
    characters. Texts are cut there, each distinct piece goes to the library once,
    and its ids are remembered; a text with any other white space goes to the
    library whole. The memory outlives a task where Spark reuses its worker: it
    hangs on the library's own module. It has two halves: when the newer holds ``kept``
    pieces it becomes the older, whose pieces come back as texts use them and are
    forgotten otherwise. Fewer pieces take less memory and more time.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        import tokenizers

        store = tokenizers.__dict__.setdefault("_remembered_pieces", {})
        if path not in store:
            library = tokenizers.Tokenizer.from_file(path)
            library.encode_special_tokens = True  # their strings in a text are ordinary text
            store[path] = (library, {}, {}, {})
        self.library, self.pieces, self.older, self.tails = store[path]
        self.kept = kept

    def _model_ids(self, pre_token):
        """Ids of one pre-token: its bytes written as the vocabulary writes them, through the library's model."""
        if pre_token.isascii():  # printable: only the blank is written otherwise
            written = pre_token.replace(" ", BYTE_LETTERS[32])
        else:
            written = pre_token.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.library.model.tokenize(written)]).tobytes()

    def _learn(self, missing):
        """Remember pieces: ``\\n``, ``\\0x`` for x at a line start, x for x after a blank.

        Letters with punctuation behind them are two pre-tokens, whose ids the
        library's model gives; any other piece goes through the library whole.
        """
        raw, names = [], []
        pieces = self.pieces
        for piece in missing:
            first = piece[:1] == "\0"
            stem = piece.rstrip(PUNCTUATION)
            body = stem[1:] if first else stem
            if body.isalpha():
                ids = pieces.get(stem) or self.older.get(stem) or self._model_ids(body if first else " " + body)
                pieces[stem] = ids
                if len(stem) < len(piece):
                    tail = piece[len(stem):]
                    if tail not in self.tails:
                        self.tails[tail] = self._model_ids(tail)
                    pieces[piece] = ids + self.tails[tail]
                continue
            body = piece[1:] if first else piece
            if piece != "\n" and (not body or body[0].isspace() or body[-1].isspace()):
                pieces[piece] = None
            else:
                raw.append(body if first or piece == "\n" else " " + body)
                names.append(piece)
        if not raw:
            return
        found = self.library.encode(raw, is_pretokenized=True, add_special_tokens=False)
        data = np.array(found.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(raw) + 1))).tolist()
        for name, start, end in zip(names, cuts, cuts[1:]):
            self.pieces[name] = data[start:end]

    def encode_many(self, texts):
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        split = [None if "\0" in t else ("\0" + t.replace("\n", " \n \0")).split(" ") if t else [] for t in texts]
        if len(self.pieces) > self.kept:
            self.older.clear()
            self.older.update(self.pieces)
            self.pieces.clear()
            self.tails.clear()
        missing = {p for parts in split if parts for p in parts if p not in self.pieces}
        known = {p for p in missing if p in self.older}
        self.pieces.update((p, self.older[p]) for p in known)
        if len(known) < len(missing):
            self._learn(missing - known)
        out = []
        for text, parts in zip(texts, split):
            ids = None if parts is None else [self.pieces[p] for p in parts]
            if ids is None or None in ids:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(ids))
        return out


def encoded(texts, path, size=1 << 20, kept=KEPT_PIECES):
    """``(index, ids)`` of each text in order, encoded about ``size`` characters at a time."""
    encoder = Encoder(path, kept)
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size or i == len(texts) - 1:
            yield from zip(range(start, i + 1), encoder.encode_many(texts[start:i + 1]))
            start, total = i + 1, 0
