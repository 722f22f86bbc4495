"""Chat formatting: typed content parts, a turn template, and reading the output back.

A turn has a role and content parts (text, image, audio, document). A visitor
flattens the parts in order into one string: text is escaped, every other part
becomes a placeholder, is recorded as an attachment and counts the tokens that
it expands to. The template then marks the turn. Everything is done row by row;
a conversation is the sequence of its rows ordered by turn, role and text.

Template, one piece per turn::

    user         <s>[INST] TEXT [/INST]
    system       <<SYS>> TEXT <</SYS>>
    assistant     TEXT </s>
    other role   <|role:ROLE|> TEXT <|end|>

Escaping: a control string inside a text, with n backslashes before it, gets
n + 1 more; in the output a control string is a mark only if no backslash
stands before it. Marks have a space on the text's side, so a text cannot
merge with them. Unescaping removes them again, so the change is reversible.

Null texts and null parts count as empty, null roles as an empty role. Repeated
rows and turns of one number are all kept, in the order named above. A null
conversation id is a conversation of its own. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import map_batches

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role:|<\|end\|>|<\|(?:image|audio|document):"
_ESCAPE = re.compile(rf"(\\*)({CONTROL})")

# Tokens an attachment expands to: an image by patches, audio by seconds, a document by pages.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<place:int,kind:string,ref:string,tokens:bigint>"
FORMATTED = f"conv_id long, turn long, role string, piece string, loss boolean, attachments array<{ATTACHMENT}>, expanded_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1][: len(m[1]) // 2] + m[2] if m[1] else m[0], text)


class Flatten:
    """Visits the parts of one turn in order."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part:
            getattr(self, part["kind"] if part["kind"] in ("image", "audio", "document") else "plain")(part)

    def plain(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def attach(self, part: dict, tokens: int) -> None:
        place = len(self.attachments)
        self.attachments.append({"place": place, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})
        self.out.append(f"<|{part['kind']}:{place}|>")

    def image(self, part: dict) -> None:
        self.attach(part, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0.0) * AUDIO_RATE))

    def document(self, part: dict) -> None:
        self.attach(part, (part["pages"] or 0) * PAGE_TOKENS)


def mark(role: str | None, body: str) -> str:
    if role == "user":
        return f"<s>[INST] {body} [/INST]"
    if role == "assistant":
        return f" {body} </s>"
    if role == "system":
        return f"<<SYS>> {body} <</SYS>>"
    return f"<|role:{escape(role or '').replace('|', '||')}|> {body} <|end|>"


_PIECES = (
    ("user", "<s>[INST] ", " [/INST]"),
    ("system", "<<SYS>> ", " <</SYS>>"),
    ("assistant", " ", " </s>"),
)


def read_piece(piece: str) -> tuple[str, str, bool]:
    """Role, text with its placeholders, and whether the loss covers the text, out of a formatted piece."""
    for role, opening, closing in _PIECES:
        if piece.startswith(opening) and piece.endswith(closing):
            return role, unescape(piece[len(opening) : len(piece) - len(closing)]), role == "assistant"
    end = 0
    head = re.match(r"<\|role:((?:[^|]|\|\|)*)\|> ", piece, re.S)
    end = head.end()
    return unescape(head[1].replace("||", "|")), unescape(piece[end : len(piece) - len(" <|end|>")]), False


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted piece per row of ``conv_id``, ``turn``, ``role`` and ``text`` or ``parts`` (array of ``PART``)."""
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else F.lit(None).cast(f"array<{PART}>")
    text = F.col("text") if "text" in turns.columns else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text.alias("text"), parts.alias("parts"))
    kinds = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("turn", pa.int64()),
            ("role", pa.string()),
            ("piece", pa.string()),
            ("loss", pa.bool_()),
            (
                "attachments",
                pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])),
            ),
            ("expanded_tokens", pa.int64()),
        ]
    )

    def step(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                visitor = Flatten()
                for part in row["parts"] if row["parts"] is not None else [{"kind": "text", "text": row["text"]}]:
                    visitor.visit(part)
                out.append(
                    {
                        "conv_id": row["conv_id"],
                        "turn": row["turn"],
                        "role": row["role"],
                        "piece": mark(row["role"], "".join(visitor.out)),
                        "loss": row["role"] == "assistant",
                        "attachments": visitor.attachments,
                        "expanded_tokens": sum(a["tokens"] for a in visitor.attachments),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return map_batches(rows, step, FORMATTED)


def in_order(formatted: DataFrame) -> DataFrame:
    """All rows of a conversation in one partition, one after the other."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from its pieces.

    The rows are streamed in order: a worker holds one piece and the running
    digests, so a very long conversation needs no more memory than a short one.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))

    def step(batches):
        key, begun = None, False
        turns = loss = turns_digest = loss_digest = chars = None

        def close():
            return {
                "conv_id": key,
                "n_turns": turns,
                "turns_sha256": turns_digest.hexdigest(),
                "loss_chars": loss,
                "loss_sha256": loss_digest.hexdigest(),
                "formatted_chars": chars,
            }

        for batch in batches:
            done = []
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun or conv != key:
                    if begun:
                        done.append(close())
                    key, begun, turns, loss, chars = conv, True, 0, 0, 0
                    turns_digest, loss_digest = hashlib.sha256(), hashlib.sha256()
                role, text, learns = read_piece(piece)
                turns += 1
                chars += len(piece)
                turns_digest.update(f"{role}\n{text}\n".encode())
                if learns:
                    loss += len(text)
                    loss_digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kinds)
        if begun:
            yield pa.RecordBatch.from_pylist([close()], schema=kinds)

    return map_batches(
        in_order(formatted).select("conv_id", "piece"),
        step,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
