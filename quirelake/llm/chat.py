r"""Chat formatting as a prefix tree.

A turn is written as `### role`, a newline, the text and `</turn>` with a newline. Inside roles and texts a backslash goes before each backslash, `<` and `#` (and a newline
in a role becomes `\n`), so that control strings never occur inside and reading back is exact. Loss falls on assistant texts alone.

Conversations that begin with the same turns share the nodes of these turns. Distinct conversations are sorted by the chain of hashes of their turns, so those that share
turns stand together; each task walks its range depth first and fills packs. In a pack a shared turn is written once; each node has its place in the text, the position id of its first
character (the others follow; it goes on from its parent's end; position_ids() lists them for a whole pack) and the intervals of the text that its characters may attend to: its ancestors' and,
causally, its own. A pack is closed once what its conversations have added to it, beyond the ancestors that the pack before held too, fills PACK characters and as much as these repeated ancestors.
So shared turns are written twice as often as needed at most, however long they are, once more a task at the ends of ranges, and a first turn shared by very many conversations never makes one task.

Nulls and edge cases. A null text is an empty one, a null role an empty role. Rows of a conversation are taken by turn, then role, then text; null turns come first; repeated rows are
turns each. Rows with a null conv_id belong together with nothing: each is a conversation of one turn. Equal conversations share their leaf and each get a result row. A conversation is one record and is
held in memory as such, read and written by a few copies of its text; a pack holds up to 2^31 characters, as its places are 32-bit numbers, and a conversation that needs more is an error, not cut; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

PACK = 1 << 16
#: Hex digits of a turn's hash: 128 bits, so that no two of any number of turns that fit a cluster share one by chance.
DIGITS = 32
LOSS_ROLE = "assistant"
HEAD, END = "### ", "</turn>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("#", "\\#")


def unescape(text: str) -> str:
    # Each `<` and `#` stands behind its own backslash; without these, backslashes are in pairs.
    return text.replace("\\<", "<").replace("\\#", "#").replace("\\\\", "\\")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in it."""
    head, body = f"### {escape_role(role)}\n", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        start = formatted.find("\n", at) + 1
        end = _end(formatted, start) if start and formatted.startswith(HEAD, at) else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(formatted[at + len(HEAD) : start - 1]), unescape(formatted[start:end])))
        at = end + len(END)
    return out


def _end(formatted: str, start: int) -> int:
    """Where the text that begins at start ends: at the first end mark whose `<` isn't escaped, that is, behind an even number of backslashes. -1 if there is none."""
    at = formatted.find(END, start)
    while at >= 0:
        first = at
        while first > start and formatted[first - 1] == "\\":
            first -= 1
        if (at - first) % 2 == 0:
            return at
        at = formatted.find(END, at + 1)
    return -1


def chains(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order) and chain: DIGITS hex digits for each turn, that depend on all turns up to it."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = F.array(turn).alias("turns")
    conv = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).unionByName(rows.where("conv_id IS NULL").select("conv_id", one))
    link = lambda last, t: F.substring(F.sha2(F.concat(last, F.length(t["role"]).cast("string"), F.lit("|"), t["role"], t["text"]), 256), 1, DIGITS)
    chain = F.aggregate("turns", F.array().cast("array<string>"), lambda a, t: F.concat(a, F.array(link(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")), t))))
    return conv.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.array_join(chain, "").alias("chain"))


NODE = "start int, end int, position int, parent int, loss_start int, loss_end int, attends array<int>"
PACKS = f"text string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, leaves array<struct<chain:string,node:int>>"
_PACK_ARROW = pa.schema([("text", pa.string()), ("nodes", pa.list_(pa.struct([*((n, pa.int32()) for n in ("start", "end", "position", "parent", "loss_start", "loss_end")), ("attends", pa.list_(pa.int32()))]))), ("leaves", pa.list_(pa.struct([("chain", pa.string()), ("node", pa.int32())])))])


class Pack:
    """One packed text; conversations are added in the order of their chains."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[str, int]] = []
        self.again = 0  # characters of ancestors that the pack before holds too

    def add(self, chain: str, turns: list[dict], before: str = "") -> None:
        """before: for a pack's first conversation, the chain of the last one of the pack before."""
        keys = [chain[i : i + DIGITS] for i in range(0, len(chain), DIGITS)]
        shared = 0
        while shared < min(len(keys), len(self.path)) and self.path[shared][0] == keys[shared]:
            shared += 1
        repeated = len(os.path.commonprefix([chain, before])) // DIGITS
        del self.path[shared:]
        for key, turn in zip(keys[shared:], turns[shared:]):
            parent = self.path[-1][1] if self.path else -1
            text, a, b = format_turn(turn["role"], turn["text"])
            up = self.nodes[parent] if self.path else None
            attends = [] if up is None else list(up["attends"]) if up["attends"] else []
            if up is not None:  # ancestors' intervals, joined where they touch
                if attends and attends[-1] == up["start"]:
                    attends[-1] = up["end"]
                else:
                    attends += [up["start"], up["end"]]
            loss = turn["role"] == LOSS_ROLE
            self.nodes.append({"start": self.size, "end": self.size + len(text), "position": 0 if up is None else up["position"] + up["end"] - up["start"], "parent": parent, "loss_start": self.size + a if loss else -1, "loss_end": self.size + b if loss else -1, "attends": attends})
            self.parts.append(text)
            self.size += len(text)
            if len(self.path) < repeated:
                self.again += len(text)
            self.path.append((key, len(self.nodes) - 1))
        self.leaves.append({"chain": chain, "node": self.path[-1][1]})

    def full(self, size: int) -> bool:
        return self.size - self.again >= max(size, self.again)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}], schema=_PACK_ARROW)


def position_ids(nodes: list[dict]) -> list[int]:
    """The position id of each character of a pack's text."""
    return [n["position"] + i for n in nodes for i in range(n["end"] - n["start"])]


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, last = Pack(), ""
        for b in batches:
            for chain, turns in zip(b.column(0).to_pylist(), b.column(1)):
                if pack.full(size):
                    yield pack.batch()
                    pack = Pack()
                pack.add(chain, turns.as_py(), last if not pack.nodes else "")
                last = chain
        if pack.leaves:
            yield pack.batch()

    return run


def packed(conversations: DataFrame, size: int = PACK) -> DataFrame:
    """Packs of the distinct conversations of chains()."""
    one = conversations.select("chain", "turns").dropDuplicates(["chain"])
    return one.repartitionByRange("chain").sortWithinPartitions("chain").mapInArrow(_pack(size), PACKS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, nodes, leaves in zip(*(c.to_pylist() for c in b.columns)):
            for leaf in leaves:
                last = nodes[leaf["node"]]
                spans = [*last["attends"], last["start"], last["end"]]
                formatted = "".join(text[a:e] for a, e in zip(spans[::2], spans[1::2]))
                turns, line = parse(formatted), []
                i = leaf["node"]
                while i >= 0:
                    line.append(nodes[i])
                    i = nodes[i]["parent"]
                loss = "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in reversed(line) if n["loss_start"] >= 0)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((leaf["chain"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["chain", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(packs: DataFrame) -> DataFrame:
    """Digests of each distinct conversation, from the packs alone."""
    return packs.mapInArrow(_read, "chain string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(rows: DataFrame, size: int = PACK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packs, conv_id with chain for each conversation, digests by chain), each written."""
    conv = written(chains(rows), "chains")
    packs = written(packed(conv, size), "packs")
    return packs, conv.select("conv_id", "chain"), written(read_back(packs), "digests")


PROBE = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    _, members, digests = formatted(rows.unionByName(probe))
    return members.join(digests, "chain").drop("chain")


SQL = r"""
WITH r AS (
  SELECT CASE WHEN conv_id IS NULL THEN -row_number() OVER () END AS own, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT NULL, -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT NULL, -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(13 + length(regexp_replace(role, '([\\<#\n])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<#])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id, own
"""
