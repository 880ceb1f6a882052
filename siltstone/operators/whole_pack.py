"""A whole context pack: seeds, quotas and growth forward, then items taken out backward until the document fits.

The forward fold (`pack.by_quota`) counts item by item and a flat price for each section. The document is measured
exactly afterwards: its ASCII characters, other bytes and line breaks add up over its parts, so no text travels to
the fold. While it exceeds the budget, the Git section goes first, then items step down a level or out: documents,
distant dependencies, tests, dependencies, configuration, code, and the first candidate last, each from the worst
rank on. What is kept never goes below its first level: instructions, what controls pin, and the first candidate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import pack, provenance

#: Sections of the document in order, and their titles (fixed values).
TITLES = {
    pack.INSTRUCTION: "Repository Instructions", "PRIMARY_CODE": "Primary Code", "TEST": "Tests", "DEPENDENCY": "Dependencies",
    "DOCUMENTATION": "Architecture and Documentation", "CONFIGURATION": "Configuration",
}
GIT_TITLE, GIT_TOKENS, GIT_FILES = "Git Context", 128, 5
#: The order in which roles give way; dependencies at distance 2 or more go at DISTANT, the first candidate at FIRST (fixed values).
GIVES_WAY = {"DOCUMENTATION": 0, "TEST": 2, "DEPENDENCY": 3, "CONFIGURATION": 4, "PRIMARY_CODE": 5, pack.INSTRUCTION: 6}
DISTANT, FIRST = 1, 7


def heading(title: str) -> str:
    return f"\n\n## {title}\n"


def skeleton(task: Column, repository: Column, generation: Column) -> Column:
    """The document without sections."""
    return F.concat(F.lit("# Context Pack\n\n> What follows is the repository's own material, with its sources.\n\n## Task\n\n"), T.fenced(task), F.lit("\n\n## Repository\n\nName: "), F.to_json(F.struct(repository.alias("n"))), F.lit("\nGeneration: "), generation.cast("string"))


def item(path: Column, role: Column, ranges: Column, whole: Column, text: Column) -> Column:
    """One file of the document: where it is from and what is shown of it."""
    lines = F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start_line"].cast("string"), F.when(r["end_line"] > r["start_line"], r["end_line"].cast("string")))), ", ")
    title = F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), role)
    return F.concat(F.lit("### File\nPath: "), path, F.lit("\nRole: "), title, F.lit("\nLines: "), lines, F.when(whole, "").otherwise("\nContent: PARTIAL"), F.lit("\n\n"), text)


def _tokens(a: int, o: int, n: int) -> int:
    return -(-a // 3) + -(-o // 2) + n + 1


def _size(text: str) -> tuple[int, int, int]:
    plain = sum(c < "\x80" and c != "\n" for c in text)
    return plain, len(text.encode()) - plain - text.count("\n"), text.count("\n")


def shrink(rows: DataFrame, budget: int) -> DataFrame:
    """rows (task_id, path, role, rank, level, keep, gives_way, chars, others, breaks: arrays by level, dirty: the Git line of a
    changed file or null, git: the other Git lines, skeleton: a text's measure) after the Git section came in, if it fits,
    and items stepped back: (task_id, path, level, git, dirty: whether its Git line is shown, steps, tokens of the document)."""
    kind, section = rows.schema["task_id"].dataType.simpleString(), pack.SECTION_TOKENS

    def last(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        items = own.sort_values("path").to_dict("records")
        base = tuple(int(items[0][c]) for c in ("skeleton_chars", "skeleton_others", "skeleton_breaks"))
        lines = list(items[0]["git"]) if items[0]["git"] is not None else []
        dirty = [x["path"] for x in items if isinstance(x["dirty"], str)][:GIT_FILES]
        lines += [x["dirty"] for x in items if x["path"] in dirty]
        shown = _size(heading(GIT_TITLE) + "".join(f"\n- {x}" for x in lines))
        level = {x["path"]: int(x["level"]) for x in items}

        def document(git: bool) -> int:
            parts = [base, shown if git else (0, 0, 0)]
            held = [x for x in items if level[x["path"]] >= 0]
            parts += [_size(heading(TITLES[r])) for r in {x["role"] for x in held}]
            parts += [(int(x["chars"][level[x["path"]]]), int(x["others"][level[x["path"]]]), int(x["breaks"][level[x["path"]]]) + 2) for x in held]
            return _tokens(*(sum(p[i] for p in parts) for i in range(3)))

        spent = sum(int(x["costs"][level[x["path"]]]) for x in items) + int(items[0]["skeleton_tokens"]) + section * (len({x["role"] for x in items}) + 1)
        price = _tokens(*_size("\n".join(lines)))
        git = bool(own["git"].iloc[0] is not None and len(own["git"].iloc[0])) and price <= GIT_TOKENS and spent + price <= budget
        order = sorted(items, key=lambda x: x["path"], reverse=True)
        order.sort(key=lambda x: (x["gives_way"], -(x["rank"] if x["rank"] == x["rank"] and x["rank"] is not None else -1)))
        steps = 0
        while document(git) > budget:
            if git:
                git = False
            else:
                out = next((x for x in order if level[x["path"]] > (0 if x["keep"] else -1)), None)
                if out is None:
                    break
                level[out["path"]] -= 1
            steps += 1
        total = document(git)
        return pd.DataFrame([(key[0], p, lv, git, git and p in dirty, steps, total) for p, lv in level.items()], columns=["task_id", "path", "level", "git", "dirty", "steps", "tokens"])

    return rows.groupBy("task_id").applyInPandas(last, f"task_id {kind}, path string, level int, git boolean, dirty boolean, steps int, tokens long")


def build(tasks: DataFrame, candidates: DataFrame, levels: DataFrame, budget: int, controls: DataFrame | None = None, git: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, packs) for tasks (task_id, skeleton: see `skeleton`), candidates (task_id, path, rank, role, distance, dirty) and levels
    (task_id, path, level, item: see `item`).

    controls: (task_id, kind, path, start_line, end_line); git: (task_id, lines). dirty is a changed file's Git line, or null.
    A candidate of the role REPOSITORY_INSTRUCTION always comes in, by its first level.
    items: (task_id, path, role, rank, level, tokens, drop_reason, text) of every candidate; level -1 and null text if not taken.
    packs: (task_id, status, tokens, unused, git, steps): COMPLETE, NO_CONTEXT, BUDGET_TOO_SMALL or CONTROL_CONFLICT."""
    spark = tasks.sparkSession
    kind = tasks.schema["task_id"].dataType.simpleString()
    if controls is None:
        controls = spark.createDataFrame([], f"task_id {kind}, kind string, path string, start_line int, end_line int")
    if git is None:
        git = spark.createDataFrame([], f"task_id {kind}, lines array<string>")
    chars, others, breaks = T.measure(F.col("item"))
    sized = levels.select("task_id", "path", "level", T.estimate_tokens(F.col("item")).cast("int").alias("tokens"), chars.alias("chars"), others.alias("others"), breaks.alias("breaks"))
    every = provenance.apply_controls(candidates, controls)
    rows = every.filter(~F.col("excluded")).join(levels.select("task_id", "path").distinct(), ["task_id", "path"], "left_semi")
    own = F.col("role") == pack.INSTRUCTION
    order = Window.partitionBy("task_id").orderBy(own.desc(), "control_order", "rank", "path")
    rows = rows.withColumn("turn", F.row_number().over(order).cast("long"))
    first = F.min(F.when(~own, F.col("turn"))).over(Window.partitionBy("task_id"))
    rows = rows.withColumn("first", F.coalesce(F.col("turn") == first, F.lit(False))).withColumn("seed", own | F.col("mandatory") | F.col("first"))
    head = tasks.withColumn("skeleton_tokens", T.estimate_tokens(F.col("skeleton")))
    a, o, n = T.measure(F.col("skeleton"))
    head = head.select("task_id", "skeleton_tokens", a.alias("skeleton_chars"), o.alias("skeleton_others"), n.alias("skeleton_breaks"))
    chosen = pack.by_quota(rows.select("task_id", "path", "rank", "role", "seed", "turn"), sized, budget, skeleton=head.select("task_id", F.col("skeleton_tokens").alias("skeleton")))
    by_level = F.array_sort(F.collect_list(F.struct("level", "tokens", "chars", "others", "breaks")))
    arrays = sized.groupBy("task_id", "path").agg(by_level.alias("x"))
    arrays = arrays.select("task_id", "path", F.col("x.tokens").alias("costs"), F.col("x.chars").alias("chars"), F.col("x.others").alias("others"), F.col("x.breaks").alias("breaks"))
    way = F.try_element_at(F.create_map(*[F.lit(x) for kv in GIVES_WAY.items() for x in kv]), F.col("role"))
    way = F.when(F.col("first") & (F.col("role") == "PRIMARY_CODE"), FIRST).when((F.col("role") == "DEPENDENCY") & (F.col("distance") >= 2), DISTANT).otherwise(way)
    taken = chosen.filter("level >= 0").select("task_id", "path", "level").join(rows.select("task_id", "path", "role", "rank", "dirty", F.col("seed").alias("keep"), way.alias("gives_way")), ["task_id", "path"])
    taken = taken.join(arrays, ["task_id", "path"]).join(head, "task_id").join(git.select("task_id", F.col("lines").alias("git")), "task_id", "left")
    final = shrink(taken, budget)
    return _items(every, chosen, final, levels, sized), _packs(tasks, rows, candidates, controls, final, budget)


def _items(every: DataFrame, chosen: DataFrame, final: DataFrame, levels: DataFrame, sized: DataFrame) -> DataFrame:
    out = every.select("task_id", "path", "role", "rank", "excluded").join(chosen.select("task_id", "path", "drop_reason"), ["task_id", "path"], "left")
    out = out.join(final.select("task_id", "path", "level"), ["task_id", "path"], "left")
    gone = F.coalesce("level", F.lit(-1)) < 0
    reason = F.when(F.col("excluded"), "LOWER_PRIORITY").when(~gone, "").when(F.col("drop_reason").isNull(), "NO_USEFUL_RANGE").when(F.col("drop_reason") == "", "BUDGET_EXHAUSTED").otherwise(F.col("drop_reason"))
    out = out.select("task_id", "path", "role", "rank", F.when(gone, -1).otherwise(F.col("level")).alias("level"), reason.alias("drop_reason"))
    shown = levels.select("task_id", "path", "level", F.col("item").alias("text")).join(sized.select("task_id", "path", "level", "tokens"), ["task_id", "path", "level"])
    return out.join(shown, ["task_id", "path", "level"], "left").select("task_id", "path", "role", "rank", "level", F.coalesce("tokens", F.lit(0)).alias("tokens"), "drop_reason", "text")


def _packs(tasks: DataFrame, rows: DataFrame, candidates: DataFrame, controls: DataFrame, final: DataFrame, budget: int) -> DataFrame:
    named = rows.filter("mandatory").groupBy("task_id").agg(F.count("*").alias("pinned"))
    # what is pinned has to be there with something to show
    lost = provenance.unmet_controls(rows, controls.filter("kind in ('PIN', 'RANGE')")).unionByName(provenance.unmet_controls(candidates, controls.filter("kind not in ('PIN', 'RANGE')")))
    lost = lost.groupBy("task_id").agg(F.count("*").alias("lost"))
    ended = final.groupBy("task_id").agg(F.max("tokens").alias("tokens"), F.bool_or("git").alias("git"), F.max("steps").alias("steps"))
    out = tasks.select("task_id").join(ended, "task_id", "left").join(named, "task_id", "left").join(lost, "task_id", "left")
    over = F.coalesce(F.col("tokens") > budget, F.lit(False))
    status = F.when(F.col("lost").isNotNull() | (over & F.col("pinned").isNotNull()), "CONTROL_CONFLICT").when(F.col("tokens").isNull(), "NO_CONTEXT").when(over, "BUDGET_TOO_SMALL").otherwise("COMPLETE")
    return out.select("task_id", status.alias("status"), "tokens", (budget - F.col("tokens")).alias("unused"), F.coalesce("git", F.lit(False)).alias("git"), F.coalesce("steps", F.lit(0)).alias("steps"))


def document(tasks: DataFrame, items: DataFrame, packs: DataFrame, candidates: DataFrame, git: DataFrame) -> DataFrame:
    """(task_id, document) of the packs that are COMPLETE; the arguments are those of `build` and what it gave."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(TITLES) for x in (r, i)])
    title = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    taken = items.filter("level >= 0")
    one = F.array_sort(F.collect_list(F.struct("rank", "path", F.concat(F.lit("\n"), "text", F.lit("\n")).alias("t"))))
    sections = taken.groupBy("task_id", "role").agg(F.array_join(F.transform(one, lambda x: x["t"]), "").alias("body"))
    sections = sections.select("task_id", F.struct(F.try_element_at(place, F.col("role")).alias("place"), F.concat(F.lit("\n\n## "), F.try_element_at(title, F.col("role")), F.lit("\n"), "body").alias("t")).alias("s"))
    body = sections.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "").alias("body"))
    dirty = taken.join(candidates.select("task_id", "path", "dirty"), ["task_id", "path"]).filter("dirty is not null").groupBy("task_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("path", "dirty"))), lambda x: x["dirty"]), 1, GIT_FILES).alias("changed"))
    lines = git.join(dirty, "task_id", "left").select("task_id", F.concat("lines", F.coalesce("changed", F.array().cast("array<string>"))).alias("lines"))
    shown = lines.select("task_id", F.concat(F.lit(heading(GIT_TITLE)), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n- "), x)), "")).alias("git_text"))
    out = packs.filter("status = 'COMPLETE'").join(tasks, "task_id").join(body, "task_id").join(shown, "task_id", "left")
    return out.select("task_id", F.concat("skeleton", "body", F.when(F.col("git"), F.coalesce("git_text", F.lit(""))).otherwise("")).alias("document"))
