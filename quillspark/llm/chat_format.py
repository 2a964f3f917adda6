"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are ordered by ``turn`` (ties by role and text; all are
kept).  Prefix sums of turn costs choose spans of whole turns: a span ends before
the turn that would exceed the budget, and a turn dearer than the budget is a span
of its own, so that no text is cut.  The first window is its span.  Each later
window repeats the system turn (if the conversation begins with one), then as many
of the turns before its span as the history budget holds, then its span.  The loss
mask covers assistant texts of spans, never repeated ones: each target counts once.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts ``<``,
backslashes and ``|`` in a row get one backslash more, and roles are URL-encoded,
so that control strings come from the template alone and :func:`read_back` is exact.

Null texts and roles are empty.  Rows with a null ``conv_id`` form one
conversation; an empty table gives no rows; other columns are not read.  A digest
covers a conversation, whose turns therefore meet in one row; :func:`chat_rows` gathers
a window's only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(column):
    return F.regexp_replace(column, r"<(\\*)\|", r"<\\$1|")


def unescaped(sql: str) -> str:
    return rf"regexp_replace({sql}, r'<\\(\\*)\|', r'<$1|')"


def _turns(df: DataFrame, conv: str) -> DataFrame:
    """Turns in order, with their costs and the sums of these, written as they will stand in windows."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("cost", F.ceil(F.octet_length("text") / 4).cast("long") + 4)
    return rows.select(
        "conv_id",
        F.row_number().over(order).alias("idx"),
        F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("prefix"),
        "cost",
        "role",
        F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body"),
    )


def _started(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Beside ``turns``: ``sys`` (1 if the first is the system's) and ``starts``, the first turn of each window's span."""
    kept = turns.withColumn("sys", F.expr("if(turns[0].role = 'system', 1, 0)"))
    later = f"greatest({int(budget)} - {int(history)} - sys * turns[0].cost, 1)"
    return kept.withColumn(
        "starts",
        F.expr(
            f"""aggregate(turns, named_struct('starts', cast(array() as array<int>), 'most', -1L),
                (s, t) -> if(t.prefix > s.most,
                    named_struct('starts', array_append(s.starts, t.idx), 'most', t.prefix - t.cost + if(size(s.starts) = 0, {int(budget)}, {later})), s),
                s -> s.starts)"""
        ),
    )


def chat_windows(df: DataFrame, budget: int = 1024, history: int = 256, conv: str = "conv_id") -> DataFrame:
    """One row a conversation: ``conv_id`` and ``windows``, an array of structs.

    A window has ``formatted``, ``repeated`` (how many of its turns are repeated)
    and ``loss`` (spans of code points, end exclusive, that are targets).  A cost
    is four tokens a turn and one for each four bytes of text begun.
    """
    rows = _turns(df, conv)
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "prefix", "cost", "role", "head", "body"))).alias("turns"))
    kept = _started(turns, budget, history)
    # Every turn costs 4 at least, so that the history looks no further back than history / 4 turns.
    back = max(1, history // 4)
    kept = kept.withColumn(
        "spans",
        F.expr(
            f"""transform(starts, (s, k) -> named_struct(
                'own', slice(turns, s, if(k + 1 < size(starts), starts[k + 1], size(turns) + 1) - s),
                'again', if(k = 0, slice(turns, 1, 0), concat(slice(turns, 1, sys),
                    filter(slice(turns, greatest(s - {back}, 1 + sys), least(s - 1 - sys, {back})),
                        t -> turns[s - 2].prefix - t.prefix + t.cost <= {int(history)})))))"""
        ),
    )
    written = lambda a: f"array_join(transform({a}, t -> concat(t.head, t.body, '{END[:-1]}\\n')), '')"
    kept = kept.withColumn("spans", F.expr(f"transform(spans, w -> named_struct('own', w.own, 'repeated', size(w.again), 'again', {written('w.again')}))"))
    windows = F.expr(
        f"""transform(spans, w -> named_struct('formatted', concat(w.again, {written('w.own')}), 'repeated', w.repeated,
            'loss', aggregate(w.own, named_struct('at', char_length(w.again), 'found', cast(array() as array<struct<start:int, end:int>>)),
                (s, t) -> named_struct('at', s.at + char_length(t.head) + char_length(t.body) + {len(END)},
                    'found', if(t.role = 'assistant', array_append(s.found, named_struct('start', s.at + char_length(t.head), 'end', s.at + char_length(t.head) + char_length(t.body))), s.found)),
                s -> s.found)))"""
    )
    return kept.select("conv_id", windows.alias("windows"))


def chat_rows(df: DataFrame, budget: int = 1024, history: int = 256, conv: str = "conv_id") -> DataFrame:
    """One row a window: ``conv_id``, ``window`` (from 0), ``formatted``, ``repeated``, ``loss``, as :func:`chat_windows` has them.

    A conversation's costs alone are gathered to choose spans; texts meet by window, so
    that a long conversation's are dealt over tasks.
    """
    rows = _turns(df, conv)
    light = _started(rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "prefix", "cost", "role"))).alias("turns")), budget, history)
    back = max(1, history // 4)
    spans = F.expr(
        f"""transform(starts, (s, k) -> named_struct('window', k, 'own', s, 'end', if(k + 1 < size(starts), starts[k + 1], size(turns) + 1), 'sys', if(k = 0, 0, sys),
            'again', if(k = 0, s, s - size(filter(slice(turns, greatest(s - {back}, 1 + sys), least(s - 1 - sys, {back})), t -> turns[s - 2].prefix - t.prefix + t.cost <= {int(history)})))))"""
    )
    spans = light.select("conv_id", F.explode(spans).alias("w")).select("conv_id", "w.*")
    places = spans.select(F.col("conv_id").alias("c"), "window", "own", F.explode(F.expr("concat(slice(array(1), 1, sys), sequence(again, end - 1))")).alias("i"))
    met = places.join(rows, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("i") == F.col("idx")))
    turns = met.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("idx") >= F.col("own")).alias("own"), "role", "head", "body"))).alias("t"))
    loss = F.expr(
        f"""aggregate(t, named_struct('at', 0, 'found', cast(array() as array<struct<start:int, end:int>>)),
            (s, x) -> named_struct('at', s.at + char_length(x.head) + char_length(x.body) + {len(END)},
                'found', if(x.own and x.role = 'assistant', array_append(s.found, named_struct('start', s.at + char_length(x.head), 'end', s.at + char_length(x.head) + char_length(x.body))), s.found)),
            s -> s.found)"""
    )
    formatted = F.expr(f"array_join(transform(t, x -> concat(x.head, x.body, '{END[:-1]}\\n')), '')")
    return turns.select("conv_id", "window", formatted.alias("formatted"), F.expr("size(filter(t, x -> not x.own))").alias("repeated"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """From :func:`chat_windows`: ``conv_id``, ``turns`` (role and text of each turn, once), ``targets`` (texts under the mask), ``formatted_chars``."""
    body = "substring(p, instr(p, '\\n') + 1)"
    turns = f"""flatten(transform(windows, w -> transform(
        slice(split(w.formatted, r'<\\|im_start\\|>'), 2 + w.repeated, 2147483647 - 2 - w.repeated),
        p -> named_struct('role', url_decode(substring_index(p, '\\n', 1)),
            'text', {unescaped(f"left({body}, char_length({body}) - {len(END)})")}))))"""
    targets = f"flatten(transform(windows, w -> transform(w.loss, s -> {unescaped('substring(w.formatted, s.start + 1, s.end - s.start)')})))"
    return windows.select("conv_id", F.expr(turns).alias("turns"), F.expr(targets).alias("targets"), F.expr("aggregate(windows, 0L, (n, w) -> n + char_length(w.formatted))").alias("formatted_chars"))


def chat_digests(df: DataFrame, **options) -> DataFrame:
    """Per conversation what :func:`read_back` gives, as counts and SHA-256."""
    back = read_back(chat_windows(df, **options))
    said = "array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr(f"sha2(cast({said} as binary), 256)").alias("turns_sha256"),
        F.expr("aggregate(targets, 0L, (n, t) -> n + char_length(t))").alias("loss_chars"),
        F.expr("sha2(cast(array_join(targets, '') as binary), 256)").alias("loss_sha256"),
        "formatted_chars",
    )
