r"""Chat formatting with offset-aligned masks (operator 2).

A conversation is rendered whole, as ``### Role: `` + text + ``\n</turn>\n`` per turn, and encoded
once with offsets.  The sorted spans of the assistant texts and the sorted token spans are
intersected by binary search; a token is under the loss mask where the two overlap.

Texts may hold the template's own control strings.  ``escape`` puts a backslash after the first
character of every control string (and one more after any that already stand there), so a
rendered conversation holds control strings only where the template put them; ``unescape``
takes it away again.  Known roles are written capitalised, others as ``=`` and their
percent-encoded name, a missing one as ``~``; ``parse`` reads roles and texts back exactly.

Edge cases: a NULL text is an empty text; a NULL role is kept apart from an empty one in the
rendering and hashed as empty; turns sort by turn (NULL first), then role, then text, so repeated
turns stay as often as they occur; rows with a NULL ``conv_id`` form one conversation; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import ranks

KNOWN = ("system", "user", "assistant", "tool")
CLOSE = "\n</turn>\n"
_ROLE = r"(?:System|User|Assistant|Tool|~|=[A-Za-z0-9_.~%-]*): "
_PLAIN = re.compile(r"([#<])(\\*)(## " + _ROLE + r"|/turn>)")
_ESCAPED = re.compile(r"([#<])\\(\\*)(## " + _ROLE + r"|/turn>)")
_TURN = re.compile(r"### (System|User|Assistant|Tool|~|=[A-Za-z0-9_.~%-]*): ")

RESULT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_tokens long, loss_tokens long")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text) if "#" in text or "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def role_name(role: str | None) -> str:
    if role is None:
        return "~"
    return role.capitalize() if role in KNOWN else "=" + quote(role, safe="", errors="surrogatepass")


def role_of(name: str) -> str | None:
    if name == "~":
        return None
    return unquote(name[1:], errors="surrogatepass") if name.startswith("=") else name.lower()


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {role_name(role)}: ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """Read the turns back from a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        if head is None:
            raise ValueError(f"no turn starts at code point {at}")
        end = formatted.index(CLOSE, head.end())
        turns.append((role_of(head[1]), unescape(formatted[head.end():end])))
        at = end + len(CLOSE)
    return turns


_TOKENIZERS: dict = {}


def tokenizer(name: str = "byte_bpe_50k"):
    """The public vocabulary with the template's control strings as tokens of their own, and each token's bytes.

    Id ``len(ranks)`` stays free for the vocabulary's own end of text; the control strings follow it.
    """
    if name not in _TOKENIZERS:
        import public_tokenizers as P
        import tiktoken

        known = ranks(name)
        own = {s: len(known) + 1 + i for i, s in enumerate([f"### {r.capitalize()}: " for r in KNOWN] + [CLOSE])}
        size = np.zeros(len(known) + 1 + len(own), np.int64)
        for token, i in [*known.items(), *own.items()]:
            size[i] = len(token)            # control strings are ASCII
        _TOKENIZERS[name] = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=known, special_tokens=own), size
    return _TOKENIZERS[name]


def encode(text: str, name: str = "byte_bpe_50k") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a whole text, and the code points where each token starts and ends.

    Tokens follow each other byte by byte; a token that begins or ends inside a character takes
    the whole character as its place.
    """
    encoding, size = tokenizer(name)
    ids = np.array(encoding.encode(text, allowed_special="all"), np.int32)
    ends = np.cumsum(size[ids])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(raw) == len(text):
        return ids, ends - size[ids], ends
    character = np.cumsum((raw & 0xC0) != 0x80)         # number of the character of each byte, from 1
    return ids, character[ends - size[ids]] - 1, character[ends - 1]


def loss_mask(spans: list[tuple[int, int]], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Rows ``token, start, stop`` of every token part inside a span, by binary search for all spans.

    Token starts and ends both ascend (parts of one character share its span), so the tokens that
    meet a span are one run.
    """
    a, b = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(stops, a, "right"), np.searchsorted(starts, b, "left")
    n = last - first
    token = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    return np.stack([token, np.maximum(np.repeat(a, n), starts[token]), np.minimum(np.repeat(b, n), stops[token])], axis=1)


def covered(mask: np.ndarray) -> list[tuple[int, int]]:
    """The masked text as disjoint ascending spans (tokens of one character overlap)."""
    if not len(mask):
        return []
    reach = np.maximum.accumulate(mask[:, 2])
    cut = np.flatnonzero(mask[1:, 1] > reach[:-1]) + 1
    return list(zip(mask[np.append(0, cut), 1].tolist(), reach[np.append(cut - 1, len(mask) - 1)].tolist()))


def format_conversation(turns: list[tuple[str | None, str]], name: str = "byte_bpe_50k") -> dict:
    """Formatted text, ids, masked token parts and the spans of the assistant texts."""
    text, spans = render(turns)
    ids, starts, stops = encode(text, name)
    return {"text": text, "ids": ids, "mask": loss_mask(spans, starts, stops), "spans": spans}


def digest(conv_id, turns: list[tuple[str | None, str]], name: str) -> tuple:
    """The contract's row, read back from the formatted text and its mask."""
    out = format_conversation(turns, name)
    back = parse(out["text"])
    said = hashlib.sha256()
    for role, text in back:
        said.update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
    # the mask's text; no part reaches over the control strings between two assistant texts, and a text
    # is one part if the mask is whole, so each is unescaped on its own
    loss = "".join(unescape(out["text"][a:b]) for a, b in covered(out["mask"]))
    return (conv_id, len(back), said.hexdigest(), len(loss),
            hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(out["text"]),
            len(out["ids"]), len(np.unique(out["mask"][:, 0])))


def sorted_turns(rows: DataFrame) -> DataFrame:
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
                        F.coalesce("text", F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def format_all(rows: DataFrame, name: str = "byte_bpe_50k", digests: bool = True) -> DataFrame:
    """Format every conversation; one row each.

    Conversations stream through a task in sorted order, so memory holds one of them and a batch
    of results.  With ``digests`` the row is ``RESULT``; else ``conv_id, text, ids, mask``.
    """
    schema = RESULT if digests else ("conv_id long, text string, ids array<int>, "
                                     "mask array<struct<token:int,start:int,stop:int>>")
    names = [x.split()[0] for x in RESULT.split(", ")] if digests else ["conv_id", "text", "ids", "mask"]
    mask_type = pa.list_(pa.struct([("token", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    text_columns = {"turns_sha256", "loss_sha256", "text"}

    def row(conv_id, turns):
        if digests:
            return digest(conv_id, turns, name)
        out = format_conversation(turns, name)
        return conv_id, out["text"], out["ids"], [dict(zip(("token", "start", "stop"), m)) for m in out["mask"].tolist()]

    def table(done):
        kinds = [pa.string() if n in text_columns else pa.list_(pa.int32()) if n == "ids" else mask_type if n == "mask"
                 else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    def run(batches):
        at, turns, done, begun = None, [], [], False
        for batch in batches:
            conv, role, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text"))
            for c, r, t in zip(conv, role, text):
                if begun and c != at:
                    done.append(row(at, turns))
                    turns = []
                at, begun = c, True
                turns.append((r, t))
                if len(done) >= 500:
                    yield table(done)
                    done = []
        if begun:
            done.append(row(at, turns))
            yield table(done)

    return sorted_turns(rows).mapInArrow(run, schema)


#: fixed values: a conversation whose texts hold control strings
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def with_planted(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    extra = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
