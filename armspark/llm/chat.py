"""Chat formatting with typed content parts.

A visitor walks the parts of a turn in order. Text is escaped; an image, audio or document part becomes
a numbered placeholder, its reference is recorded, and it counts as many tokens as it expands to.

Control strings inside texts are made harmless reversibly: behind the first character of a
control string one backslash is put in, and a string that already has backslashes there gets one more.

Turns are dealt by conversation and sorted inside the task, then streamed turn by turn: no task holds a
conversation, only the turn at hand. A digest over one conversation is a running hash, so one conversation is
read by one task; its memory does not grow.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of this template, and the control strings of common templates.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = r"/?s>|/?INST\]|/?SYS\]|</?SYS>>|\|"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={CONTROL})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

IMAGE_PATCH, IMAGE_EXTRA = 28, 2  # pixels per token side; begin and end tokens
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 256
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    """Roles stand in one line: backslash and line break are spelled out, then control strings escaped."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass
class PartVisitor:
    """Flattens the typed parts of one turn; the numbers of placeholders run through the turn.

    Unknown kinds are kept as documents, NULL parts and NULL sizes count nothing.
    """

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        wide, high = (-(-int(part.get(k) or 0) // IMAGE_PATCH) for k in ("width", "height"))
        self._place("image", part, wide * high + IMAGE_EXTRA)

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, int(-(-(part.get("seconds") or 0.0) * AUDIO_TOKENS_PER_SECOND // 1)))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, int(part.get("pages") or 0) * DOCUMENT_TOKENS_PER_PAGE)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments) + 1
        self.pieces.append(f"<|{kind}_{number}|>")
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PIECES = (
    "conv_id long, n long, piece string, loss_start int, loss_end int, "
    "attachments array<struct<number:int,kind:string,ref:string,tokens:long>>"
)


def with_parts(turns: DataFrame) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as turns of one text part."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.lit(None).cast(t).alias(n) for n, t in (x.split(":") for x in PART[7:-1].split(",")[2:])],
    )
    return turns.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def in_order(turns: DataFrame) -> DataFrame:
    """All turns of a conversation in one task and in order; ties of a turn by role and content."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), "parts"
    )
    return rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id"), F.asc_nulls_first("turn"), "role", F.to_json("parts")
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, in order inside its task: (conv_id, n, piece, loss_start, loss_end, attachments).

    The pieces of a conversation, joined by n, are its formatted text. loss_start and loss_end bound the characters of the
    piece that are trained on; NULL for turns of other roles.

    NULL role or text: empty. NULL conv_id: one conversation of its own. NULL turn: first. Repeated rows are
    repeated turns. An empty table gives an empty result. Other columns are ignored.
    """
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n", pa.int64()),
            ("piece", pa.string()),
            ("loss_start", pa.int32()),
            ("loss_end", pa.int32()),
            (
                "attachments",
                pa.list_(
                    pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
                ),
            ),
        ]
    )

    def run(batches):
        at, n = object(), 0
        for batch in batches:
            out = []
            for conv, role, parts in zip(*(batch.column(i) for i in (0, 2, 3))):
                conv, role = conv.as_py(), role.as_py()
                n = n + 1 if conv == at else 1
                at = conv
                visitor = PartVisitor()
                for part in parts.as_py() or ():
                    visitor.visit(part)
                head = OPEN + escape_role(role) + MIDDLE
                body = "".join(visitor.pieces)
                loss = (len(head), len(head) + len(body)) if role == TRAINED_ROLE else (None, None)
                out.append((conv, n, head + body + CLOSE, *loss, visitor.attachments))
            columns = list(zip(*out)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return in_order(turns).mapInArrow(run, PIECES)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_attachments long, attachment_tokens long"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse formatted pieces again and digest what they say, one row per conversation.

    Takes the rows of ``format_turns`` as they lie; the turns and the trained text are read from the formatted
    characters and the mask, not from the input.
    """
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches):
        done, at, state = [], object(), None

        def close():
            turns, loss, numbers = state[0].hexdigest(), state[1].hexdigest(), state[2]
            done.append((at, numbers[0], turns, numbers[1], loss, *numbers[2:]))

        def flush():
            columns = list(zip(*done)) or [[] for _ in names]
            types = [pa.string() if "sha256" in n else pa.int64() for n in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            done.clear()
            return batch

        for batch in batches:
            for conv, piece, start, end, attached in zip(*(batch.column(i) for i in (0, 2, 3, 4, 5))):
                conv, piece = conv.as_py(), piece.as_py()
                if state is None or conv != at:
                    if state is not None:
                        close()
                    at, state = conv, (hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0, 0])
                turns, loss, numbers = state
                for found in _TURN.finditer(piece):
                    said = f"{unescape_role(found[1])}\n{unescape(found[2])}\n"
                    turns.update(said.encode("utf-8", "surrogatepass"))
                    numbers[0] += 1
                if start.as_py() is not None:
                    trained = unescape(piece[start.as_py() : end.as_py()])
                    loss.update(trained.encode("utf-8", "surrogatepass"))
                    numbers[1] += len(trained)
                numbers[2] += len(piece)
                for one in attached.as_py() or ():
                    numbers[3] += 1
                    numbers[4] += one["tokens"]
            if len(done) > 5000:
                yield flush()
        if state is not None:
            close()
        yield flush()

    return pieces.mapInArrow(run, DIGEST)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text)
    + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|/?SYS\]|</?SYS>>|\|)'))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM turns GROUP BY conv_id
"""
