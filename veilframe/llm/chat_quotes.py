"""Chat formatting by quotation linking (operator 1).

A line's quote level is the number of `>` that lead it. Runs of lines of one level without a blank
one are passages; they are normalised (lower case, white space as one space) and hashed. Quoted
passages are joined by hash to the first message that wrote the passage itself, of the same
conversation if it has one, else of any. A message answers the latest of its own conversation's
messages that it quotes at level one; without such a link, the turn before. Following these links
gives each message its thread's root and its depth, by doubling: each round joins every message to
the ancestor of its ancestor, so rounds grow with the logarithm of the longest thread.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_LEAD = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
BLANK = " \t\n\r\f\v"


def passages(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(unquoted text, [(level, normalised passage)] in order); level 0 are the message's own."""
    own, out, level, run = [], [], 0, []
    for line in (text or "").split("\n"):
        m = _LEAD.match(line)
        here, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not m:
            own.append(line)
        blank = not rest.strip(BLANK)
        if run and (blank or here != level):
            out.append((level, run))
            run = []
        if not blank:
            level = here
            run.append(rest)
    if run:
        out.append((level, run))
    return "\n".join(own).strip(BLANK), [(k, _SPACE.sub(" ", "\n".join(r)).strip(" ").lower()) for k, r in out]


def _parse(batches):
    for b in batches:
        body, quotes, own, key = [], [], [], []
        for t in b.column(3).to_pylist():
            text, found = passages(t)
            body.append(text)
            hashed = [(k, hashlib.sha256(p.encode("utf-8", "surrogatepass")).digest()) for k, p in found]
            quotes.append([{"level": k, "h": h} for k, h in hashed if k])
            own.append(sorted({h for k, h in hashed if not k}))
            key.append(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest())
        kind = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.binary())]))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(key, pa.binary()), pa.array(body, pa.string()), pa.array(quotes, kind), pa.array(own, pa.list_(pa.binary()))], names=["conv_id", "turn", "role", "key", "body", "quotes", "own"])


def reply_order(messages: DataFrame) -> DataFrame:
    """Per row of messages (conv_id, turn, role, text): conv_id, turn, role, n_quotes, n_linked, parent_turn, root_turn, depth, body.

    Conversations in reply order are the rows sorted by (conv_id, root_turn, depth, turn): rows stay
    apart, so a conversation of any length is never gathered in one task. n_quotes counts quoted
    passages, n_linked those whose original was found. body is the text without quoted lines. A null
    or empty text has an empty body and no quotes. Rows that share (conv_id, turn) are one node of
    the thread: each row is returned, and the latest parent of them counts. A null conv_id or turn
    takes no part: parent null, root its own turn, depth 0. An empty table gives an empty result.
    """
    schema = "conv_id long, turn long, role string, key binary, body string, quotes array<struct<level:int,h:binary>>, own array<binary>"
    rows = written(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text").mapInArrow(_parse, schema), "messages")
    placed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = placed.select("conv_id", "turn", F.explode("own").alias("h"))
    quoted = placed.dropDuplicates(["conv_id", "turn", "key"]).select("conv_id", "turn", "key", F.explode("quotes").alias("q")).select("conv_id", "turn", "key", "q.level", "q.h")
    here = own.groupBy("h", "conv_id").agg(F.min("turn").alias("first"))
    anywhere = own.groupBy("h").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    linked = quoted.join(here, ["h", "conv_id"], "left").join(anywhere, "h", "left")
    inside = F.coalesce(F.col("first") < F.col("turn"), F.lit(False))
    outside = F.coalesce((F.col("low") != F.col("conv_id")) | (F.col("high") != F.col("conv_id")), F.lit(False))
    links = written(
        linked.groupBy("conv_id", "turn", "key").agg(
            F.count_if(inside | outside).alias("n_linked"),
            F.max(F.when(inside & (F.col("level") == 1), F.col("first"))).alias("parent"),
        ),
        "links",
    )
    turns = placed.select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    cited = links.groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"))
    graph = turns.join(cited, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    graph = graph.select("conv_id", "turn", F.coalesce("parent", "previous").alias("parent"))
    graph = written(graph.select("*", F.coalesce("parent", "turn").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")), "graph")
    while True:
        above = graph.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        step = graph.join(above, ["conv_id", "up"])
        if step.where("higher <> up").isEmpty():
            break
        graph = written(step.select("conv_id", "turn", "parent", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "graph")
    out = rows.join(links.drop("parent"), ["conv_id", "turn", "key"], "left").join(graph, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.coalesce("up", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "body",
    )


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lines AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM m),
leads AS (SELECT *, regexp_extract(line, '^[ \t]*((>[ \t]?)+)', 0) AS lead FROM lines),
levels AS (SELECT id, conv_id, turn, n, line, length(lead) - length(replace(lead, '>', '')) AS level, substr(line, length(lead) + 1) AS rest FROM leads),
marked AS (SELECT *, regexp_full_match(rest, '[ \t\n\r\f\v]*') AS blank FROM levels),
starts AS (SELECT *, CASE WHEN NOT blank AND (n = 1 OR lag(blank) OVER o OR lag(level) OVER o <> level) THEN 1 ELSE 0 END AS new FROM marked WINDOW o AS (PARTITION BY id ORDER BY n)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY n) AS run FROM starts WHERE NOT blank),
parts AS (SELECT id, conv_id, turn, level, run, lower(trim(regexp_replace(string_agg(rest, chr(10) ORDER BY n), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS p FROM runs GROUP BY ALL),
own AS (SELECT DISTINCT p, conv_id, turn FROM parts WHERE level = 0),
here AS (SELECT p, conv_id, min(turn) AS first FROM own GROUP BY ALL),
anywhere AS (SELECT p, min(conv_id) AS low, max(conv_id) AS high FROM own GROUP BY p),
linked AS (SELECT q.id, q.conv_id, q.turn, q.level, h.first, coalesce(h.first < q.turn, false) AS inside, coalesce(a.low <> q.conv_id OR a.high <> q.conv_id, false) AS outside
    FROM parts q LEFT JOIN here h USING (p, conv_id) LEFT JOIN anywhere a USING (p) WHERE q.level > 0),
links AS (SELECT id, count(*) AS n_quotes, count(*) FILTER (inside OR outside) AS n_linked FROM linked GROUP BY id),
cited AS (SELECT conv_id, turn, max(first) FILTER (inside AND level = 1) AS parent FROM linked GROUP BY ALL),
turns AS (SELECT DISTINCT conv_id, turn FROM m),
graph AS (SELECT t.conv_id, t.turn, coalesce(c.parent, b.turn) AS parent FROM turns t LEFT JOIN cited c USING (conv_id, turn) LEFT JOIN turns b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1),
thread AS (SELECT conv_id, turn, parent, turn AS root, 0 AS depth FROM graph WHERE parent IS NULL
    UNION ALL SELECT g.conv_id, g.turn, g.parent, t.root, t.depth + 1 FROM graph g JOIN thread t ON g.conv_id = t.conv_id AND g.parent = t.turn),
bodies AS (SELECT id, trim(string_agg(line, chr(10) ORDER BY n) FILTER (level = 0), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM marked GROUP BY id)
SELECT m.conv_id, m.turn, m.role, coalesce(l.n_quotes, 0)::BIGINT AS n_quotes, coalesce(l.n_linked, 0)::BIGINT AS n_linked, t.parent AS parent_turn,
    coalesce(t.root, m.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth, coalesce(b.body, '') AS body
FROM m LEFT JOIN links l USING (id) LEFT JOIN bodies b USING (id) LEFT JOIN thread t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
