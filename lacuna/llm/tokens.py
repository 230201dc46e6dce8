"""Token ids of whole texts by a public byte-level vocabulary that is given as a path."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: The white space of the vocabulary's pattern (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A long run of it, but for the last character if text follows.
RUN = re.compile(f"[{SPACE}]{{64,}}(?:(?=[{SPACE}](?![{SPACE}]))|\\Z)")
#: Two characters of white space, or of what Python adds to it, side by side.
PAIR = re.compile(r"\s\s")
#: The branch of the vocabulary's pattern that looks ahead.
AHEAD = r"|\s+(?!\S)"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """Bytes of each entry of a byte-level vocabulary, whose entries write byte b as the b-th of a fixed row of printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    return {bytes(byte[c] for c in word): i for word, i in vocab.items() if all(c in byte for c in word)}


class Tokens:
    """Encodes one text at a time, as the library does. The vocabulary's own special strings in a text take the library's path; all else the faster equal one.

    The pattern that divides a text makes a run of white space one piece, but
    for its last character if text follows. It looks for that by going back,
    one step for each character, which fails on runs of a million. So long
    runs are cut out by that rule and encoded as the pieces that they are; what
    is between them begins and ends where pieces do.

    Without white space side by side, that branch matches a text's last
    character at most, which the branch after it matches too. So such texts
    take the pattern without it, which needs no going back and is faster.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        ranks = _ranks({w: i for w, i in self.slow.get_vocab(with_added_tokens=False).items() if w not in special})
        self.special = tuple(special)
        # Texts with special strings go another way; but without any given here, each place of a text would be tried for an empty one.
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.apart = tiktoken.Encoding("apart", pat_str=public_tokenizers.PATTERN.replace(AHEAD, ""), mergeable_ranks=ranks, special_tokens=special)
        self.piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        if not PAIR.search(text):
            return _plain(self.apart, text)
        parts, at = [], 0
        for run in RUN.finditer(text):
            parts += [_plain(self.fast, text[at : run.start()]), _plain(self.piece, run[0])]
            at = run.end()
        if not parts:
            return _plain(self.fast, text)
        return np.concatenate([*parts, _plain(self.fast, text[at:])])


def _plain(encoding, text: str) -> np.ndarray:
    return encoding.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)
