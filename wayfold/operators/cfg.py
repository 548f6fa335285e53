"""Control flow of instruction lists: successors, bounded paths and what the branches require."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from wayfold.operators.scans import carry_forward
from wayfold.storage import discard, materialize

EVENT = ("map_id", "event_id")
_COMPILED_END = "END IF Condition Group State (Compiled)"


def _number() -> Column:
    return F.coalesce(F.col("label"), F.regexp_extract("name", r"Label\s+(-?\d+)$", 1).try_cast("int"))


def labels(instructions: DataFrame) -> DataFrame:
    """(event, label, label_index): where each label stands; of repeated ones the last counts.

    instructions: map_id, event_id, index, name, label, skip. The number is the label argument or stands in the name.
    """
    found = instructions.filter(F.col("name").startswith("Label")).select(*EVENT, _number().alias("label"), "index").filter("label is not null")
    return found.groupBy(*EVENT, "label").agg(F.max("index").alias("label_index"))


def successors(instructions: DataFrame) -> DataFrame:
    """(event, index, name, target, taken, rank): the branches of each instruction in order; a null target ends the event.

    Labels are found as by labels(), in the one shuffle that brings an event's rows together.
    """
    is_label = F.col("name").startswith("Label")
    d = instructions.withColumn("_last", F.max("index").over(W.partitionBy(*EVENT))).withColumn("_label", F.when(is_label, _number()).otherwise(F.col("label")))
    stands = F.max(F.when(is_label, F.col("index"))).over(W.partitionBy(*EVENT, "_label"))
    d = d.withColumn("label_index", F.when(F.col("_label").isNotNull(), stands))
    name, i = F.col("name"), F.col("index")
    following = F.when(i + 1 <= F.col("_last"), i + 1)
    jump = i + F.col("skip") + 1

    def branch(target, taken: str | None, when: Column | None = None) -> Column:
        s = F.struct(target.cast("int").alias("target"), F.lit(taken).alias("taken"))
        return s if when is None else F.when(when, s)

    def either(*branches: Column, otherwise: str) -> Column:
        found = F.array_compact(F.array(*branches))
        return F.when(F.size(found) > 0, found).otherwise(F.array(branch(F.lit(None), otherwise)))

    has_label, has_next = F.col("label_index").isNotNull(), following.isNotNull()
    fall = branch(following, "end_if_fallthrough", has_next)
    stop = F.array(branch(F.lit(None), "end_if_terminate"))
    ways = (
        F.when(name == "GOTO Unconditionally", either(branch(F.col("label_index"), "label", has_label), otherwise="unknown_label"))
        .when(name.startswith("GOTO IF"), either(branch(F.col("label_index"), "condition_true", has_label), branch(following, "condition_false", has_next), otherwise="unknown_branch"))
        .when(name.startswith("SKIP IF"), either(branch(jump, "condition_true_skip", jump <= F.col("_last")), branch(following, "condition_false_fallthrough", has_next), otherwise="unknown_skip"))
        .when((name == _COMPILED_END) | name.startswith("END IF") & has_next, F.concat(F.array_compact(F.array(fall)), stop))
        .when(name.startswith("END"), F.array(branch(F.lit(None), "end")))
        .when(name.startswith("SKIP"), either(branch(jump, "unconditional_skip", jump.isNotNull()), otherwise="unknown_skip"))
        .otherwise(F.array(branch(following, None)))
    )
    return d.select(*EVENT, "index", "name", F.posexplode(ways).alias("rank", "b")).select(*EVENT, "index", "name", "b.target", "b.taken", "rank")


def blocks(branches: DataFrame, targets: DataFrame) -> DataFrame:
    """(event, at, ways): straight runs of instructions by their first one, and where each run leads.

    A run begins at instruction 0, at a target (event, goal) and wherever a branch leads, and ends at the next branch, before
    the next beginning or at a gap in the numbers; nothing enters it elsewhere. ways lists (target, step) of the branches that
    do not end the event, in order; step is index:taken, null where nothing is decided.
    """
    each = branches.groupBy(*EVENT, "index").agg(F.array_sort(F.collect_list(F.struct("rank", "target", "taken"))).alias("b"))
    first = F.col("b")[0]
    each = each.withColumn("_after", F.lead("index").over(W.partitionBy(*EVENT).orderBy("index")))
    plain = (F.size("b") == 1) & first["taken"].isNull() & (first["target"].isNull() | F.coalesce(first["target"] == F.col("_after"), F.lit(False)))
    way = F.filter("b", lambda x: x["target"].isNotNull())
    ways = F.transform(way, lambda x: F.struct(x["target"].alias("target"), F.concat_ws(":", F.col("index").cast("string"), x["taken"]).alias("_step"), x["taken"].alias("taken")))
    ways = F.transform(ways, lambda x: F.struct(x["target"].alias("target"), F.when(x["taken"].isNotNull(), x["_step"]).alias("step")))
    each = materialize(each.select(*EVENT, "index", plain.alias("plain"), F.when(plain, first["target"]).alias("next"), ways.alias("ways")), "steps")
    led = each.filter(~F.col("plain")).select(*EVENT, F.explode("ways.target").alias("index"))
    starts = led.union(each.select(*EVENT, F.lit(0).alias("index"))).union(targets.select(*EVENT, F.col("goal").alias("index"))).distinct()
    starts = starts.withColumn("starts", F.lit(True))
    follows = starts.select(*EVENT, (F.col("index") - 1).alias("index"), F.lit(True).alias("_stop"))
    marked = each.join(starts, [*EVENT, "index"], "left").join(follows, [*EVENT, "index"], "left")
    ends = ~F.col("plain") | F.col("next").isNull() | F.col("_stop").isNotNull()
    # the end of a run is the nearest one from here on: a scan in falling order
    marked = marked.withColumns({"end": F.when(ends, F.struct("index", "ways")), "_back": -F.col("index")})
    return carry_forward(marked, "end", EVENT, "_back").filter("starts").select(*EVENT, F.col("index").alias("at"), F.col("end.ways").alias("ways"))


def paths_by_levels(branches: DataFrame, goal: DataFrame, most_paths: int, most_steps: int, together: int, max_rounds: int) -> DataFrame:
    """bounded_paths() of events of any size; goal: event, goal, a written table without repeated rows.

    A round follows the first `together` unfinished paths of each target by one straight run (blocks()). A path's key
    is the list of the branches it took, so the order of keys is the depth-first order: when a
    target has most_paths paths, those with a greater key are dropped, and it ends when no lesser one is open.
    """
    key = [*EVENT, "goal"]
    runs = materialize(blocks(branches, goal), "runs")
    steps, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    start = goal.select(*key, F.lit(0).alias("at"), numbers.alias("key"), steps.alias("trace"), numbers.alias("seen"), F.lit(False).alias("more"))
    open_ = materialize(start, "open")
    found = cuts = None
    first = W.partitionBy(*key).orderBy("key")
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        ranked = open_.withColumn("_r", F.row_number().over(first))
        met = ranked.filter(F.col("_r") <= together).join(runs, [*EVENT, "at"], "left")
        over = F.col("ways").isNull() | F.array_contains("seen", F.col("at")) | (F.size("trace") > most_steps)
        met = materialize(met.withColumn("state", F.when(F.col("at") == F.col("goal"), "found").when(over, "cut").otherwise("open")), "met")
        new = met.filter("state = 'found'").select(*key, "key", "trace", "more")
        if not new.isEmpty():
            every = new if found is None else found.union(new)
            found = materialize(every.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most_paths).drop("_r"), "found")
        cut = met.filter("state = 'cut'").groupBy(*key).agg(F.min("key").alias("key"))
        if not cut.isEmpty():
            cuts = materialize(cut if cuts is None else cuts.union(cut).groupBy(*key).agg(F.min("key").alias("key")), "cuts")
        several, last = F.size("ways") > 1, F.size("ways") - 1
        child = met.filter("state = 'open'").select(*key, "key", "trace", "seen", "more", "at", "ways", F.posexplode("ways").alias("i", "w"))
        child = child.select(
            *key, F.col("w.target").alias("at"), F.when(several, F.array_append("key", F.col("i"))).otherwise(F.col("key")).alias("key"),
            F.when(F.col("w.step").isNotNull(), F.array_append("trace", F.col("w.step"))).otherwise(F.col("trace")).alias("trace"),
            F.array_append("seen", F.col("at")).alias("seen"), (F.col("more") | (F.col("i") < last)).alias("more"))
        rest = child.union(ranked.filter(F.col("_r") > together).drop("_r"))
        if found is not None:
            full = found.groupBy(*key).agg(F.count("*").alias("n"), F.max("key").alias("last")).filter(F.col("n") >= most_paths)
            rest = rest.join(full, key, "left").filter(F.col("last").isNull() | (F.col("key") < F.col("last"))).drop("n", "last")
        fresh = materialize(rest, "open")
        discard(open_, met)
        open_ = fresh
    else:
        raise RuntimeError("paths did not end")
    empty = start.select(*key, "key", "trace", "more").limit(0)
    found = empty if found is None else found
    cuts = empty.select(*key, "key") if cuts is None else cuts
    ends = found.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("key", "more")).alias("last"))
    told = goal.join(ends, key, "left").join(cuts.withColumnRenamed("key", "cut"), key, "left")
    whole = F.coalesce(F.col("n"), F.lit(0)) >= most_paths
    truncated = F.when(whole, F.coalesce(F.col("cut") < F.col("last.key"), F.lit(False)) | F.col("last.more")).otherwise(F.col("cut").isNotNull())
    numbered = found.select(*key, (F.row_number().over(first) - 1).alias("path"), "trace")
    out = told.select(*key, truncated.alias("truncated")).join(numbered, key, "left")
    return out.select(*EVENT, F.col("goal").alias("target_index"), "path", F.coalesce("trace", steps).alias("trace"), "truncated")


def first_paths(ways: dict[int, list[tuple[int, str | None]]], goal: int, most_paths: int, most_steps: int, most_visits: int) -> tuple[list[list[str]], bool] | None:
    """(traces, truncated) of the first paths from 0 to goal, depth first; None if the search meets more than most_visits instructions."""
    found, trace, on, cut, visits = [], [], set(), False, 0
    todo = [(0, None, False)]  # instruction, step that leads there, whether branches are left; or None, an instruction to leave and its step
    while todo:
        at, step, more = todo.pop()
        if at is None:
            on.discard(step)
            if more:
                trace.pop()
            continue
        visits += 1
        if visits > most_visits:
            return None
        if step is not None:
            trace.append(step)
        if at != goal and at in ways and at not in on and len(trace) <= most_steps:
            on.add(at)
            todo.append((None, at, step is not None))
            last = len(ways[at]) - 1
            todo += [(*ways[at][i], more or i < last) for i in range(last, -1, -1)]
            continue
        if at == goal:
            found.append(trace.copy())
            if len(found) == most_paths:
                return found, cut or more
        else:
            cut = True
        if step is not None:
            trace.pop()
    return found, cut


def _path_batches(*limits: int):
    """Rows (event, goal, path, trace, truncated, done) from rows (event, goals, whole, b): the branches of an event; done is false where these do not suffice."""

    def run(batches):
        for batch in batches:
            b, goals = batch.column("b"), batch.column("goals").to_pylist()
            counts, inner = [len(x) for x in goals], b.flatten()
            sizes = b.value_lengths().fill_null(0).to_pylist()
            index, target, step = (inner.field(i).to_pylist() for i in ("index", "target", "step"))
            at, row, goal, path, traces, truncated, done = 0, [], [], [], [], [], []
            for r, whole in enumerate(batch.column("whole").to_pylist()):
                ways: dict[int, list] = {}
                for i in range(at, at + sizes[r]):
                    way = ways.setdefault(index[i], [])
                    if target[i] is not None:
                        way.append((target[i], step[i]))
                at += sizes[r]
                for g in goals[r]:
                    got = first_paths(ways, g, *limits) if whole else None
                    found = got[0] if got and got[0] else [None]
                    row += [r] * len(found)
                    goal += [g] * len(found)
                    path += range(len(found)) if found[0] is not None else found
                    traces += found
                    truncated += [got[1] if got else None] * len(found)
                    done += [got is not None] * len(found)
            keys = [batch.column(k).take(pa.array(row, pa.int64())) for k in EVENT]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(goal, pa.int32()), pa.array(path, pa.int32()), pa.array(traces, pa.list_(pa.string())), pa.array(truncated, pa.bool_()), pa.array(done, pa.bool_())],
                names=[*EVENT, "goal", "path", "trace", "truncated", "done"])

    return run


def bounded_paths(branches: DataFrame, targets: DataFrame, most_paths: int = 32, most_steps: int = 512, together: int = 64, max_rounds: int = 100_000, small: int = 512, visits: int = 20_000) -> DataFrame:
    """(event, target_index, path, trace, truncated): simple paths from instruction 0 to each target, depth first.

    branches: successors(); targets: event, target_index. trace lists index:taken of the decisions.
    A target's first most_paths paths are given, and truncated tells that the search was cut: a
    path that runs into itself, out of the event or over most_steps decisions before the last given path, or a branch left after it.

    An event of at most `small` branches is one row and is searched where it lies; what is larger, or takes more than
    `visits` instructions for a target, is followed by paths_by_levels(). The two numbers change no result.
    """
    goal = materialize(targets.select(*EVENT, F.col("target_index").cast("int").alias("goal")).dropna().distinct(), "targets")
    step = F.when(F.col("taken").isNotNull(), F.concat_ws(":", F.col("index").cast("string"), "taken"))
    counted = branches.select(*EVENT, F.struct(F.col("index").cast("int").alias("index"), "rank", "target", step.alias("step")).alias("b"), F.count("*").over(W.partitionBy(*EVENT)).alias("n"))
    whole = F.col("n") <= small
    events = counted.groupBy(*EVENT).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.when(whole, F.col("b")))).alias("b"))
    asked = goal.groupBy(*EVENT).agg(F.collect_list("goal").alias("goals")).join(events, list(EVENT), "left")
    asked = asked.select(*EVENT, "goals", F.coalesce(whole, F.lit(True)).alias("whole"), F.coalesce("b", F.array().cast(events.schema["b"].dataType)).alias("b"))
    kinds = {f.name: f.dataType for f in goal.schema}
    fields = T.StructType([*[T.StructField(k, kinds[k]) for k in EVENT], T.StructField("goal", T.IntegerType()), T.StructField("path", T.IntegerType()), T.StructField("trace", T.ArrayType(T.StringType())), T.StructField("truncated", T.BooleanType()), T.StructField("done", T.BooleanType())])
    tried = materialize(asked.mapInArrow(_path_batches(most_paths, most_steps, visits), fields), "tried")
    discard(goal)
    out = tried.filter("done").select(*EVENT, F.col("goal").alias("target_index"), "path", F.coalesce("trace", F.array().cast("array<string>")).alias("trace"), "truncated")
    rest = tried.filter("not done").select(*EVENT, "goal")
    if rest.isEmpty():
        return out
    rest = materialize(rest, "targets")
    wide = branches.join(rest.select(*EVENT).distinct(), list(EVENT), "left_semi")
    return out.union(paths_by_levels(wide, rest, most_paths, most_steps, together, max_rounds))


def required_truth(taken: Column) -> Column:
    """What a branch's condition must be for the path to take it: true, false, or null if it has none."""
    return F.when(taken.isin("condition_true", "condition_true_skip", "end_if_terminate"), F.lit(True)).when(taken.isin("condition_false", "condition_false_fallthrough", "end_if_fallthrough"), F.lit(False))


def guard_expressions(paths: DataFrame) -> DataFrame:
    """(expression_id, kind, terms, occurrences, unresolved): each path's ordered requirements as one all_of expression.

    Equal expressions are one row named by the hash of their canonical text; unresolved counts the
    decisions that state no truth.
    """
    parts = F.transform("trace", lambda t: F.struct(F.split(t, ":")[0].cast("int").alias("index"), required_truth(F.split(t, ":")[1]).alias("truth")))
    e = paths.filter("path is not null").withColumn("terms", parts)
    text = F.to_json(F.struct(F.lit("all_of").alias("kind"), F.col("terms")))
    return e.groupBy(F.substring(F.sha2(text, 256), 1, 16).alias("expression_id")).agg(
        F.lit("all_of").alias("kind"), F.first("terms").alias("terms"), F.count("*").alias("occurrences"),
        F.first(F.size(F.filter("terms", lambda t: t["truth"].isNull()))).alias("unresolved"))


def event_status(bindings: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """(map_id, event_id, status, n_bindings, n_instructions) of the events that bindings (map_id, event_id) name.

    status is source_event_file_missing without a file (map_id), source_event_missing without an
    event (map_id, event_id, n_instructions), else source_event_decoded.
    """
    asked = bindings.groupBy(*EVENT).agg(F.count("*").alias("n_bindings"))
    has_file = files.select("map_id").distinct().withColumn("_file", F.lit(True))
    found = events.groupBy(*EVENT).agg(F.max("n_instructions").alias("n_instructions"))
    got = asked.join(has_file, "map_id", "left").join(found, list(EVENT), "left")
    status = F.when(F.col("_file").isNull(), "source_event_file_missing").when(F.col("n_instructions").isNull(), "source_event_missing").otherwise("source_event_decoded")
    return got.select(*EVENT, status.alias("status"), "n_bindings", "n_instructions")


def group_atoms(instructions: DataFrame) -> DataFrame:
    """(event, result_group, atoms): the IF instructions (index, name, result_group) that feed a condition group, in order; those on groups themselves are none."""
    fits = F.col("name").startswith("IF ") & ~F.contains("name", F.lit("Condition Group")) & F.col("result_group").isNotNull()
    return instructions.filter(fits).groupBy(*EVENT, "result_group").agg(F.array_sort(F.collect_list(F.struct("index", "name"))).alias("atoms"))


def enrich_flags(rows: DataFrame, key: str, flags: str, catalog: DataFrame) -> DataFrame:
    """(key, flag_records): the distinct flags of each row in order, with text and status from catalog (flag, text, status), missing without one.

    Flags are exploded, joined and regrouped, so a nested structure needs no recursive rewriting.
    """
    one = catalog.groupBy("flag").agg(F.min(F.struct("text", "status")).alias("c"))
    ids = rows.select(key, F.explode(F.array_distinct(flags)).alias("flag")).join(one, "flag", "left")
    record = F.struct("flag", F.col("c.text").alias("text"), F.coalesce("c.status", F.lit("missing")).alias("status"))
    return ids.groupBy(key).agg(F.array_sort(F.collect_list(record)).alias("flag_records"))
