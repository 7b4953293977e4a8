"""Token ids of whole texts by an installed public vocabulary's rank file."""

from __future__ import annotations

import re
import zlib
from array import array

#: a matcher with a stack handles shorter runs of white space by itself
LONG_RUN = 50_000
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def encode_text(enc, text: str) -> list[int]:
    """``enc.encode_ordinary(text)``, also for very long runs of white space:
    the pattern makes a run one pre-token, but leaves its last character to
    what follows."""
    if len(text) < LONG_RUN or not (run := _RUN.search(text)):
        return enc.encode_ordinary(text)
    out, at = [], 0
    while run:
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at:run.start()])
        out += enc._encode_single_piece(text[run.start():end])
        at, run = end, _RUN.search(text, run.end())
    return out + enc.encode_ordinary(text[at:])


def encode_whole(enc, text: str, specials: dict[str, int]) -> bytes:
    """Ids of a text as little-endian uint32 bytes; strings of ``specials``
    are their own ids, as the tokeniser treats its added tokens."""
    out = array("I")
    pieces = re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if any(s in text for s in specials) else [text]
    for piece in pieces:
        if piece in specials:
            out.append(specials[piece])
        elif piece:
            out.extend(encode_text(enc, piece))
    return out.tobytes()


_ENCODERS: dict = {}


def worker_encoder(ranks: bytes, pattern: str):
    """The rank file's encoder, made once per Python worker."""
    key = (zlib.crc32(ranks), pattern)
    if key not in _ENCODERS:
        import base64

        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _ENCODERS[key] = tiktoken.Encoding(
            "ids", pat_str=pattern, special_tokens={},
            mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})
    return _ENCODERS[key]
