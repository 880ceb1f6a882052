"""Packing: greedy choices of files or ranges under a hard token budget.

A packer says what it wants as a table of offers: which file, in which order, until which goal is reached. The
tables are made by joins and windows; one fold goes through a task's offers (a bounded number, as 64 candidates
are offered at most) and takes what fits the budget.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import task_plan

# Fixed values.
ROLES = ["PRIMARY_CODE", "TEST", "DEPENDENCY", "DOCUMENTATION", "CONFIGURATION"]
SHARES = {"PRIMARY_CODE": 0.45, "TEST": 0.15, "DEPENDENCY": 0.15, "DOCUMENTATION": 0.1, "CONFIGURATION": 0.1}
MOST_ITEMS = {"PRIMARY_CODE": 6, "TEST": 4, "DEPENDENCY": 4, "DOCUMENTATION": 2, "CONFIGURATION": 2}
SECTION_TOKENS, CANDIDATES, MOST_FILES = 16, 64, 18
DIRECTNESS = {"IDENTITY": 0, "OWNED_SYMBOL": 1, "VERIFIED_LEXICAL": 2, "INDIRECT": 3}


def role_of(category: Column, origin: Column) -> Column:
    return (
        F.when(category == "test", "TEST").when(category == "documentation", "DOCUMENTATION").when(category == "configuration", "CONFIGURATION")
        .when(origin == "EXPANDED", "DEPENDENCY").otherwise("PRIMARY_CODE")
    )


def render_item(path: Column, role: Column, lines: Column, body: Column) -> Column:
    return F.concat(F.lit("### File\nPath: "), path, F.lit("\nRole: "), role, F.lit("\nLines: "), lines, F.lit("\n\n"), T.fenced(body))


def whole_files(candidates: DataFrame, budget: int, skeleton: int = 0) -> DataFrame:
    """candidates (task_id, path, rank, tokens) with selected and spent: in rank order, each file that still fits."""
    kind = candidates.schema["task_id"].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "path"]).reset_index(drop=True)
        spent, selected, at = skeleton, [], []
        for tokens in rows["tokens"]:
            fits = spent + tokens <= budget
            spent += tokens if fits else 0
            selected.append(bool(fits))
            at.append(spent)
        return rows.assign(selected=selected, spent=at)[["task_id", "path", "rank", "tokens", "selected", "spent"]]

    rows = candidates.select("task_id", "path", F.col("rank").cast("long").alias("rank"), F.col("tokens").cast("long").alias("tokens"))
    return rows.groupBy("task_id").applyInPandas(fold, f"task_id {kind}, path string, rank long, tokens long, selected boolean, spent long")


#: Phases whose offers enlarge a chosen file: by one level, or by every further level that fits.
STEP_UP, ALL_UP = "GROWTH", "EXPANSION"
#: A phase whose offers are taken whatever they cost.
SEED = "SEED"
_OFFER = "step int, turn long, phase string, path string, goal string, once boolean, again boolean, share double, most int"


def _costs(levels: DataFrame) -> DataFrame:
    return levels.groupBy("task_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "tokens"))), lambda x: x["tokens"]).alias("costs"))


def _first(candidates: DataFrame) -> DataFrame:
    ranked = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy("rank", "path")))
    return ranked.filter(F.col("_n") <= CANDIDATES + F.lit(1 if "seed" in candidates.columns else 0)).drop("_n")


class _Budget:
    """What one task has taken so far."""

    def __init__(self, files: pd.DataFrame, tokens: int, skeleton: int, section: int, most: int | None):
        self.files = files.set_index("path").to_dict("index")
        self.tokens, self.skeleton, self.section, self.most = tokens, skeleton, section, most
        self.level: dict[str, int] = {}

    def of_role(self, role: str) -> list[str]:
        return [p for p in self.level if self.files[p]["role"] == role]

    def cost(self, paths) -> int:
        return sum(int(self.files[p]["costs"][self.level[p]]) for p in paths)

    def spent(self) -> int:
        return self.skeleton + self.section * len({self.files[p]["role"] for p in self.level}) + self.cost(self.level)

    def put(self, path: str, level: int) -> bool:
        before = self.level.get(path)
        self.level[path] = level
        if self.spent() <= self.tokens and (self.most is None or len(self.level) <= self.most):
            return True
        if before is None:
            del self.level[path]
        else:
            self.level[path] = before
        return False

    def add(self, path: str, share: float, most: float) -> bool:
        own, x = self.of_role(self.files[path]["role"]), self.files[path]
        if len(own) >= most or self.cost(own) + x["costs"][0] > share:
            return False
        compact = sorted(range(min(len(x["costs"]), x["preferred"] + 1)), key=lambda i: (x["costs"][i], i))
        return any(self.put(path, i) for i in compact)


def fold(offers: DataFrame, files: DataFrame, budget: int, skeleton: int = 0, section: int = 0, most: int | None = None) -> DataFrame:
    """(task_id, seq, path, phase, level, spent): what is taken of offers, in their order of step and turn.

    offers: task_id and the columns of _OFFER. An offer is void once its goal is reached, that is once a file with
    that tag is taken, or, if it counts `once`, as soon as one file was tried for it. A step that runs `again` is
    repeated until a pass takes nothing. share and most bound a role's tokens and files.
    files: (task_id, path, role, tags, preferred, costs and, instead of the argument, skeleton), costs by level; a file comes in by its cheapest level up
    to the preferred one that fits."""
    kind = offers.schema["task_id"].dataType.simpleString()

    def choose(key: tuple, offered: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        empty = int(own["skeleton"].iloc[0]) if "skeleton" in own and len(own) else skeleton
        state, reached, events = _Budget(own, budget, empty, section, most), set(), []
        for _, step in offered.sort_values(["step", "turn"]).groupby("step", sort=True):
            rows, moved = step.to_dict("records"), True
            while moved:
                moved, tried = False, set()
                for o in rows:
                    path, goal = o["path"], o["goal"]
                    held = state.level.get(path)
                    if goal in reached or goal in tried or (held is None) == (o["phase"] in (STEP_UP, ALL_UP)) or path not in state.files:
                        continue
                    if o["phase"] == SEED:
                        state.level[path] = 0
                        reached.update(state.files[path]["tags"])
                        events.append((path, SEED, 0, state.spent()))
                        continue
                    if held is None:
                        done = state.add(path, o["share"], o["most"])
                        if o["once"]:
                            tried.add(goal)
                        if done:
                            reached.update(state.files[path]["tags"])
                            events.append((path, o["phase"], state.level[path], state.spent()))
                        moved |= done
                        continue
                    for level in range(held + 1, len(state.files[path]["costs"]))[: 1 if o["phase"] == STEP_UP else None]:
                        if state.put(path, level):
                            events.append((path, o["phase"], level, state.spent()))
                            moved = True
                moved = moved and bool(rows[0]["again"])
        return pd.DataFrame([(key[0], i, *e) for i, e in enumerate(events)], columns=["task_id", "seq", "path", "phase", "level", "spent"])

    out = f"task_id {kind}, seq int, path string, phase string, level int, spent long"
    files = files.toDF(*files.columns)  # columns of their own: both tables come of the same candidates
    return offers.groupBy("task_id").cogroup(files.groupBy("task_id")).applyInPandas(choose, out)


def _offers(rows: DataFrame, step: int | Column, turn: Column, phase: str | Column, goal: Column | None = None, once: bool = False, again: bool = False, share: Column | None = None, most: Column | None = None) -> DataFrame:
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    no_bound = F.lit(2**31 - 1)
    values = [of(step), turn, of(phase), F.col("path"), F.lit(None) if goal is None else goal, F.lit(once), F.lit(again), F.lit(float("inf")) if share is None else share, no_bound if most is None else most]
    names = [x.split(" ") for x in _OFFER.split(", ")]
    return rows.select("task_id", *[v.cast(kind).alias(name) for v, (name, kind) in zip(values, names, strict=True)])


def _by_role(values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("role"))


#: What stands in front of all: the repository's own instructions.
INSTRUCTION = "REPOSITORY_INSTRUCTION"


def by_quota(candidates: DataFrame, levels: DataFrame, budget: int, skeleton: int | DataFrame = 0) -> DataFrame:
    """(task_id, path, role, level, tokens, drop_reason) of candidates (task_id, path, rank, role) with levels
    (task_id, path, level, tokens): role quotas first, one item for each minor role, then growth in turn.

    Candidates may have more columns: `seed` (taken first, whatever they cost) and `turn` (their order, instead of rank).
    Instructions have the role INSTRUCTION; their cost is left out of what the roles share. skeleton: the tokens of the
    document without files, or a table (task_id, skeleton)."""
    candidates = candidates.join(skeleton, "task_id") if isinstance(skeleton, DataFrame) else candidates.withColumn("skeleton", F.lit(skeleton))
    rows = _first(candidates).join(_costs(levels), ["task_id", "path"]).filter(F.col("role").isin([*ROLES, INSTRUCTION]))
    rows = rows.withColumn("turn", F.col("turn" if "turn" in rows.columns else "rank").cast("long")).withColumn("seed", F.col("seed") if "seed" in rows.columns else F.lit(False))
    own = F.sum(F.when(F.col("role") == INSTRUCTION, F.get("costs", F.lit(0))).otherwise(0)).over(Window.partitionBy("task_id"))
    rows = rows.withColumn("free", F.greatest(F.lit(0), F.lit(budget) - F.col("skeleton") - own))
    rows = rows.withColumn("place", _by_role({r: i for i, r in enumerate(ROLES)})).withColumn("leads", F.row_number().over(Window.partitionBy("task_id", "role").orderBy("seed", "turn", "path")) == 1)
    every, rows = rows, rows.filter(F.col("role") != INSTRUCTION)
    number, count = F.col("turn"), _by_role(MOST_ITEMS)
    share = _by_role(SHARES) * F.col("free")
    minor = rows.filter((F.col("role") != ROLES[0]) & F.col("leads"))
    in_turn = lambda last: F.col("place") * 10_000 + last * 5_000 + F.col("_turn")
    numbered = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("task_id").orderBy("turn", "path")))
    offers = _offers(rows, F.col("place"), number, "QUOTA", share=share, most=count)
    offers = offers.unionByName(_offers(minor, 10, F.col("place").cast("long"), "ROLE", goal=F.col("role")))
    offers = offers.unionByName(_offers(numbered, 20, in_turn(0).cast("long"), STEP_UP, again=True))
    offers = offers.unionByName(_offers(numbered, 20, in_turn(1).cast("long"), "QUOTA", goal=F.concat(F.lit("next "), F.col("role")), once=True, again=True, most=count))
    offers = offers.unionByName(_offers(every.filter("seed"), -1, F.coalesce("turn", F.lit(0)), SEED))
    files = every.select("task_id", "path", "role", F.array("role").alias("tags"), F.lit(0).alias("preferred"), "costs", "skeleton")
    rows = every
    events = fold(offers, files, budget, section=SECTION_TOKENS)
    taken = events.groupBy("task_id", "path").agg(F.max_by("level", "seq").alias("level"))
    full = events.groupBy("task_id").agg((F.max_by("spent", "seq") >= budget).alias("full"))
    out = rows.join(taken, ["task_id", "path"], "left").join(full, "task_id", "left")
    reason = F.when(F.col("level").isNotNull(), "").when(F.coalesce("full", F.col("skeleton") >= budget), "BUDGET_EXHAUSTED").otherwise("SECTION_LIMIT")
    return out.select("task_id", "path", "role", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce(F.get("costs", F.col("level")), F.lit(0)).cast("long").alias("tokens"), reason.alias("drop_reason"))


#: Roles of a plan in order, and the weight of each (fixed values): 0 required, 1 high, 2 normal.
PLAN_ROLES = {"PRIMARY": 0, "IMPACT": 1, "VALIDATION": 1, "SUPPORT": 2}


def by_plan(candidates: DataFrame, levels: DataFrame, budget: int, skeleton: int = 0, facet: str | None = None, plan: dict[str, int] | DataFrame = PLAN_ROLES) -> DataFrame:
    """(task_id, path, phase, level, spent) of candidates (task_id, path, rank, roles, facet, directness, strong and,
    if larger levels may come in at once, preferred). Ranks of a task differ, so nothing else decides between candidates.

    plan: role to weight for all tasks, with facet; or a table (task_id, weights, facet) of each task's own, whose roles of
    weight 2 have no turn of their own.

    Candidates stand in one order: by directness, weight of their best role, and rank. An anchor comes first, then an
    uncovered target facet, then uncovered roles (never past stronger direct context), then all, and last larger
    levels of what is chosen."""
    rows = _first(candidates).join(_costs(levels), ["task_id", "path"])
    if isinstance(plan, DataFrame):
        rows = rows.join(plan.select("task_id", "weights", F.col("facet").alias("wanted"), task_plan.role_order(F.col("weights")).alias("order")), "task_id")
        weight, wanted, names = F.col("weights"), F.col("wanted"), task_plan.ROLES
        step_of = lambda i, role: F.lit(1) + F.nullif(F.array_position("order", role), F.lit(0))
    else:
        weight, wanted = F.create_map(*[F.lit(x) for kv in plan.items() for x in kv]), F.lit(facet)
        names = sorted(plan, key=lambda r: (plan[r], list(plan).index(r)))
        step_of = lambda i, role: F.lit(2 + i)
    heaviest = F.coalesce(F.array_min(F.transform("roles", lambda r: F.coalesce(F.try_element_at(weight, r), F.lit(2)))), F.lit(2))
    direct = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DIRECTNESS.items() for x in kv]), F.col("directness")), F.lit(3))
    rows = rows.withColumn("direct", direct).withColumn("turn", F.row_number().over(Window.partitionBy("task_id").orderBy("direct", heaviest, "rank", "path")).cast("long"))
    target = F.coalesce(F.col("facet") == wanted, F.lit(False))
    strong = rows.filter("strong")
    anchor = F.row_number().over(Window.partitionBy("task_id").orderBy("direct", ~target, "turn")).cast("long")
    offers = _offers(strong.withColumn("anchor", anchor), 0, F.col("anchor"), "ANCHOR", goal=F.lit("anchor"))
    if facet is not None or isinstance(plan, DataFrame):
        offers = offers.unionByName(_offers(strong.filter(target), 1, F.col("turn"), "TARGET_OPPORTUNITY", goal=F.lit("target")))
    for i, role in enumerate(names):
        has = F.array_contains("roles", role)
        last = F.max(F.when(has, F.col("turn"))).over(Window.partitionBy("task_id"))
        shown = rows.withColumn("last", last).filter(has | (F.col("strong") & (F.col("turn") < F.col("last"))))
        shown = shown.withColumn("step", step_of(i, role)).filter("step is not null")
        offers = offers.unionByName(_offers(shown, F.col("step"), F.col("turn"), F.when(has, "OPPORTUNITY").otherwise("DIRECT_PRIORITY"), goal=F.lit(f"role {role}")))
    offers = offers.unionByName(_offers(rows, 100, F.col("turn"), "GLOBAL")).unionByName(_offers(rows, 101, F.col("rank").cast("long"), ALL_UP))
    tags = F.concat(F.transform("roles", lambda r: F.concat(F.lit("role "), r)), F.when(F.col("strong") & target, F.array(F.lit("anchor"), F.lit("target"))).when(F.col("strong"), F.array(F.lit("anchor"))).otherwise(F.array().cast("array<string>")))
    preferred = F.col("preferred").cast("int") if "preferred" in candidates.columns else F.lit(0)
    files = rows.select("task_id", "path", F.lit("").alias("role"), tags.alias("tags"), preferred.alias("preferred"), "costs")
    return fold(offers, files, budget, skeleton, most=MOST_FILES).select("task_id", "path", "phase", "level", "spent")
