"""Quotation linking of messages, in DataFrame functions only.

A line's quote level is the number of > marks before it (blanks may stand between them). Lines of level 0 are the
message's own text; attribution lines ("... wrote:") right before a quotation go with it. A passage is a run of lines of
one level. Passages and own text are compared by the hash of their normalised form (lower case, runs of blanks as one space, trimmed):
a quoted passage is looked up among the conversation's originals, which are each message's whole own text and each of its
own paragraphs (runs of lines without an empty line). The original of a passage is the earliest message that has it, found by a
minimum that is taken before the shuffle, so a line that thousands of messages share makes one row; only an earlier turn can be quoted.
A passage without an original is split into its lines, each looked up among the lines of own text in the same way.

A message replies to the original of its quotations of the lowest level, the latest if there are several. Threads are found by
pointer doubling over the messages that quote, so a round halves the longest chain; a table in the shared folder ends each.

Conversations: a message's `position` is its place in its thread in reply order, by turn, so that a reply always stands after
what it answers; the first message has 0. Places are counted in blocks of SPAN turns, over the turns that quote, so neither a long
thread nor a turn that many rows share is one task's. `conversations` builds the threads from it, `most` turns a row.

Cases: null text has no lines (own text null); null conv_id or turn neither quote nor are quoted; several messages with one
(conv_id, turn) share their originals, and each keeps its row; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store

SPAN = 4096
_MARK = r"^[ \\t]*(?:>[ \\t]*)+"
_NORMAL = "trim(regexp_replace(lower({0}), '[ \\\\t\\\\r\\\\n]+', ' '))"


def _lines(text: str) -> str:
    """SQL: array of (level, line without marks)."""
    return f"transform(split({text}, '\\n'), l -> struct(length(regexp_replace(regexp_extract(l, '{_MARK}', 0), '[^>]', '')) as level, regexp_replace(l, '{_MARK}', '') as line))"


def _hash(text: str) -> str:
    return f"xxhash64({_NORMAL.format(text)}, length({_NORMAL.format(text)}))"


# Runs of lines of one level, in order: (level, text).
_RUNS = """aggregate(lines, cast(array() as array<struct<level:int,text:string>>), (a, x) ->
  IF(size(a) > 0 AND element_at(a, -1).level = x.level,
     concat(slice(a, 1, size(a) - 1), array(struct(x.level as level, concat(element_at(a, -1).text, '\\n', x.line) as text))),
     concat(a, array(struct(x.level as level, x.line as text)))))"""


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, own (text without quotations), levels (deepest quote level), runs (passages in order)."""
    read = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    quoting = read.withColumn("quotes", F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False)))
    lines = F.expr(f"IF(quotes, {_lines('text')}, null)")
    cut = quoting.withColumn("lines", lines).withColumn("lines", F.expr("filter(lines, (x, i) -> NOT (x.level = 0 AND x.line RLIKE 'wrote:[ \\\\t]*$' AND coalesce(get(lines, i + 1).level, 0) > 0))"))
    own = "IF(quotes, trim(BOTH '\\n' FROM array_join(transform(filter(lines, x -> x.level = 0), x -> x.line), '\\n')), text)"
    return cut.select("conv_id", "turn", "role", F.expr(own).alias("own"), F.coalesce(F.expr("array_max(transform(lines, x -> x.level))"), F.lit(0)).alias("levels"), F.expr(f"IF(quotes, filter({_RUNS}, x -> x.level > 0 AND trim(x.text) <> ''), null)").alias("runs"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Of each message conv_id, turn, role, text (without quotations), quote_levels, n_quotes (passages), n_linked (those with an
    original), reply_to (turn, or null), thread_turn (the first turn of its thread), depth (replies up to it) and position (in the
    thread)."""
    store = Store(messages.sparkSession, "chat")
    read = parse(messages, conv_col, turn_col, role_col, text_col)
    asked = store.put(read.where("size(runs) > 0 AND conv_id is not null AND turn is not null").selectExpr("conv_id", "turn", "posexplode(runs) as (n, run)").selectExpr("conv_id", "turn", "n", "run.level as level", f"{_hash('run.text')} as h", f"transform(filter(split(run.text, '\\n'), l -> trim(l) <> ''), l -> {_hash('l')}) as pieces").distinct(), "asked")
    quoted = asked.select("conv_id").distinct()
    # only conversations that quote are looked up
    own = read.where("own is not null AND turn is not null").join(quoted, "conv_id", "left_semi").select("conv_id", "turn", "own")
    units = own.selectExpr("conv_id", "turn", f"explode(array_distinct(concat(array({_hash('own')}), transform(filter(split(own, '\\n[ \\\\t]*\\n'), p -> trim(p) <> ''), p -> {_hash('p')})))) as h")
    first = units.groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    whole = asked.join(first, ["conv_id", "h"], "left").withColumn("source", F.expr("IF(source < turn, source, null)"))
    whole = store.put(whole, "whole")
    lines = own.selectExpr("conv_id", "turn", f"explode(array_distinct(transform(filter(split(own, '\\n'), l -> trim(l) <> ''), l -> {_hash('l')}))) as h").groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    split = whole.where("source is null").selectExpr("conv_id", "turn", "n", "level", "explode(pieces) as h").join(lines, ["conv_id", "h"]).where("source < turn").groupBy("conv_id", "turn", "n", "level").agg(F.max("source").alias("source"))
    links = whole.where("source is not null").select("conv_id", "turn", "n", "level", "source").unionByName(split)
    parent = links.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), F.col("source"))).alias("reply_to"), F.countDistinct("n").alias("n_linked"))
    parent = store.put(parent, "parent")
    up = store.put(parent.select("conv_id", "turn", F.col("reply_to").alias("thread_turn"), F.lit(1).cast("long").alias("depth")), "up0")
    n = 0
    while up.alias("a").join(up.select("conv_id", F.col("turn").alias("thread_turn")).alias("b"), ["conv_id", "thread_turn"], "left_semi").limit(1).count():
        n += 1
        above = up.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("further"), F.col("depth").alias("more"))
        up = store.put(up.join(above, ["conv_id", "thread_turn"], "left").select("conv_id", "turn", F.coalesce("further", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"up{n}")
        store.drop(f"up{n - 1}")
    # of each thread the turns that quote, one row each; the first message quotes nothing
    dealt = up.withColumn("block", F.floor(F.col("turn") / SPAN))
    sizes = dealt.groupBy("conv_id", "thread_turn", "block").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "thread_turn", "block", (F.sum("n").over(Window.partitionBy("conv_id", "thread_turn").orderBy("block")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "thread_turn", "block").orderBy("turn")))
    up = ranked.join(before, ["conv_id", "thread_turn", "block"]).select("conv_id", "turn", "thread_turn", "depth", (F.col("before") + F.col("place")).alias("position"))
    known = parent.join(up, ["conv_id", "turn"])
    out = read.join(known, ["conv_id", "turn"], "left")
    return out.select(F.col("conv_id").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias(text_col), F.col("levels").cast("int").alias("quote_levels"), F.greatest(F.size(F.coalesce("runs", F.expr("cast(array() as array<struct<level:int,text:string>>)"))), F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), "reply_to", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"))


def conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = SPAN) -> DataFrame:
    """The threads of link()'s rows in reply order: conv_id, thread_turn, part and messages (turn, role, text, reply_to, depth), each part with
    `most` places. Rows without a conversation or turn are in none."""
    whole = linked.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).withColumn("part", F.floor(F.col("position") / most))
    message = F.struct("position", F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), "reply_to", "depth")
    gathered = whole.groupBy(conv_col, "thread_turn", "part").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return gathered.select(conv_col, "thread_turn", "part", F.transform("m", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"), x["reply_to"].alias("reply_to"), x["depth"].alias("depth"))).alias("messages"))


ORACLE = r"""
with recursive m as (select row_number() over () as r, conv_id, turn, role, text, coalesce(regexp_matches(text, '(?m)^[ \t]*>'), false) as quotes from conversations),
cut as (select r, conv_id, turn, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as n from m where quotes),
marked as (select r, conv_id, turn, n, length(regexp_replace(regexp_extract(raw, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) as level, regexp_replace(raw, '^[ \t]*(?:>[ \t]*)+', '') as line from cut),
ahead as (select *, coalesce(lead(level) over (partition by r order by n), 0) as next from marked),
lines as (select * from ahead where not (level = 0 and regexp_matches(line, 'wrote:[ \t]*$') and next > 0)),
steps as (select *, case when lag(level) over (partition by r order by n) = level then 0 else 1 end as new from lines),
runs as (select *, sum(new) over (partition by r order by n) as run from steps),
passages as (select r, conv_id, turn, run, level, string_agg(line, chr(10) order by n) as t from runs where level > 0 group by all having trim(string_agg(line, chr(10) order by n), ' ') <> ''),
numbered as (select *, row_number() over (partition by r order by run) as k, trim(regexp_replace(lower(t), '[ \t\r\n]+', ' ', 'g')) as h from passages),
own as (select m.*, case when quotes then trim(coalesce((select string_agg(line, chr(10) order by n) from lines where lines.r = m.r and level = 0), ''), chr(10)) else text end as own,
  coalesce((select max(level) from lines where lines.r = m.r), 0) as levels from m),
known as (select conv_id, turn, unnest(list_concat([own], list_filter(regexp_split_to_array(own, '\n[ \t]*\n'), lambda p: trim(p, ' ') <> ''))) as u from own where own is not null and conv_id is not null and turn is not null),
first as (select conv_id, trim(regexp_replace(lower(u), '[ \t\r\n]+', ' ', 'g')) as h, min(turn) as source from known group by all),
single as (select conv_id, turn, unnest(list_filter(string_split(own, chr(10)), lambda p: trim(p, ' ') <> '')) as u from own where own is not null and conv_id is not null and turn is not null),
firstline as (select conv_id, trim(regexp_replace(lower(u), '[ \t\r\n]+', ' ', 'g')) as h, min(turn) as source from single group by all),
whole as (select p.*, case when source < turn then source end as source from numbered p left join first using (conv_id, h)),
pieces as (select conv_id, turn, k, level, unnest(list_filter(string_split(t, chr(10)), lambda p: trim(p, ' ') <> '')) as u from whole where source is null),
partly as (select p.conv_id, p.turn, k, level, max(source) as source from pieces p join firstline f on f.conv_id = p.conv_id and f.h = trim(regexp_replace(lower(u), '[ \t\r\n]+', ' ', 'g')) where source < turn group by all),
links as (select conv_id, turn, k, level, source from whole where source is not null union all select * from partly),
parent as (select conv_id, turn, arg_max(source, 1e9 * -level + source) as reply_to, count(distinct k) as n_linked from links group by all),
thread as (select conv_id, turn, reply_to as head, 1 as depth from parent union all select t.conv_id, t.turn, p.reply_to, t.depth + 1 from thread t join parent p on p.conv_id = t.conv_id and p.turn = t.head),
ends as (select *, row_number() over (partition by conv_id, thread_turn order by turn) as position from (select conv_id, turn, min(head) as thread_turn, max(depth) as depth from thread group by all))
select o.conv_id, o.turn, o.role, o.own as text, o.levels::int as quote_levels, (select count(*) from passages p where p.r = o.r)::int as n_quotes, coalesce(n_linked, 0)::int as n_linked, reply_to, coalesce(thread_turn, o.turn) as thread_turn, coalesce(depth, 0)::int as depth, coalesce(position, 0)::bigint as position
from own o left join parent using (conv_id, turn) left join ends using (conv_id, turn)
"""
