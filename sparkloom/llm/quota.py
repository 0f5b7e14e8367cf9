"""Samples that match target category shares, by controlled rounding and exact random-key quotas.

For every plan the categories' quotas are spread over a second attribute (the row's source) in
proportion to what is there, giving a table of fractional cells. A max-flow with lower bounds makes
every cell the floor or the ceiling of its fraction while the category totals stay exact and the
totals per source stay within the floor and the ceiling of theirs. Each cell then takes exactly its
quota of the rows with the smallest random keys: a histogram of key prefixes per cell finds the
prefix where the quota is reached, so only the rows of that one prefix are ranked, never a cell.

What a plan needs and can't have is read off a second max-flow, from the needs through the rows of
each cell: whatever it leaves of a category's need, no draw could reach. The report also names the
categories whose drawn quota is below their need though there were rows, and why.

The driver holds only the table of cells: plans x categories x sources, whatever the rows. If the
second attribute has more than ``max_strata`` values, the smaller ones share one stratum; category
quotas stay exact, and null stays a stratum of its own.

Defined cases: a null or unknown category belongs to no plan; a plan without any row draws nothing
and reports every category with a need as short; a null stratum is a stratum of its own; duplicate
rows are rows. Ties of random keys are broken by the row's id.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text forms of the difficulty enum.
DIFFICULTY_TEXTS = {"easy (1 tool call)": "ONE_TOOL_CALL", "medium (2 tool calls)": "TWO_TOOL_CALLS", "hard (3 tool calls)": "THREE_TOOL_CALLS"}

PREFIX_BITS = 14


def difficulty_name(c: Column) -> Column:
    """Enum name of either form of a difficulty."""
    out = F.trim(c)
    for text, name in DIFFICULTY_TEXTS.items():
        out = F.when(F.lower(F.trim(c)) == text, F.lit(name)).otherwise(out)
    return out


def attributes() -> dict[str, Column]:
    """Category text of a question for each attribute a plan may name."""
    return {"difficulty": difficulty_name(F.col("difficulty")), "problem_type": F.col("problem_type"), "tool_calls_required": F.col("tool_calls_required").cast("string")}


def largest_remainder(weights: list[Fraction], total: int) -> list[int]:
    """Integers next to ``weights`` that add up to ``total``; ties go to the earlier one."""
    base = [math.floor(w) for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (base[i] - weights[i], i))
    left = total - sum(base)
    for i in order[: max(0, left)]:
        base[i] += 1
    return base


def category_quotas(shares: list[int], minima: list[int], size: int, there: list[int]) -> list[int]:
    """Rows to draw per category: the rounded share, at least the minimum, at most what is there.

    Where minima lift small categories above their share, the larger ones give way, each in
    proportion to what it has above its own minimum.
    """
    wanted = largest_remainder([Fraction(s * size, 1000) for s in shares], size * sum(shares) // 1000)
    quota = [max(m, w) for m, w in zip(minima, wanted)]
    excess, spare = sum(quota) - sum(wanted), [q - m for q, m in zip(quota, minima)]
    if 0 < excess and sum(spare):
        excess = min(excess, sum(spare))
        cut = largest_remainder([Fraction(excess * s, sum(spare)) for s in spare], excess)
        quota = [q - min(c, s) for q, c, s in zip(quota, cut, spare)]
    return [min(q, t) for q, t in zip(quota, there)]


class Flow:
    """Max-flow by shortest augmenting paths on a small network."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []  # to, capacity left
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.edges))
            self.edges.append([y, c])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            came, todo = {source: -1}, deque([source])
            while todo and sink not in came:
                x = todo.popleft()
                for e in self.out[x]:
                    y, c = self.edges[e]
                    if c and y not in came:
                        came[y] = e
                        todo.append(y)
            if sink not in came:
                return total
            path, x = [], sink
            while came[x] >= 0:
                path.append(came[x])
                x = self.edges[came[x] ^ 1][0]
            step = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= step
                self.edges[e ^ 1][1] += step
            total += step


def controlled_rounding(cells: list[list[Fraction]]) -> list[list[int]]:
    """Each cell floor or ceiling; row sums (integers) kept, column sums floor or ceiling of theirs.

    Feasible by the integrality of flows with integer bounds: the fractions are a feasible flow.
    """
    n, m = len(cells), len(cells[0]) if cells else 0
    source, sink, start, end = n + m, n + m + 1, n + m + 2, n + m + 3
    flow, need = Flow(n + m + 4), [0] * (n + m + 4)

    def bounded(a: int, b: int, low: int, high: int) -> int:
        need[b] += low
        need[a] -= low
        return flow.add(a, b, high - low)

    placed = {}
    for i, row in enumerate(cells):
        total = sum(row)
        bounded(source, i, math.floor(total), math.ceil(total))
        for j, x in enumerate(row):
            placed[i, j] = bounded(i, n + j, math.floor(x), math.ceil(x))
    for j in range(m):
        total = sum(cells[i][j] for i in range(n))
        bounded(n + j, sink, math.floor(total), math.ceil(total))
    flow.add(sink, source, 1 << 60)
    for x, d in enumerate(need):
        if d > 0:
            flow.add(start, x, d)
        elif d < 0:
            flow.add(x, end, -d)
    flow.run(start, end)
    return [[math.floor(cells[i][j]) + flow.edges[placed[i, j] ^ 1][1] for j in range(m)] for i in range(n)]


def _expanded(questions: DataFrame, attrs: set[str], id_col: str, stratum: str) -> DataFrame:
    """A row for each attribute of each question: id, stratum, attribute, category."""
    known = attributes()
    if not attrs & known.keys():
        return questions.sparkSession.createDataFrame([], "row_id bigint, stratum string, attribute string, category string")
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), known[a].alias("category")) for a in sorted(attrs & known.keys())])
    return questions.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(stratum).cast("string").alias("stratum"), F.explode(pairs).alias("p")).select(
        "row_id", "stratum", "p.attribute", "p.category"
    )


#: Stratum of a cell: a named one, the one of null, or the one of all that are neither.
NULL_STRATUM, REST = "null:", "rest:"


def spark_strata(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, True) for n in names], "stratum string, is_named boolean")


def cell_stratum() -> Column:
    """The stratum's key, which keeps null apart from the rest."""
    return F.when(F.col("stratum").isNull(), NULL_STRATUM).when(F.col("is_named"), F.concat(F.lit("name:"), "stratum")).otherwise(REST)


def stratum_name(key: Column) -> Column:
    """The stratum as it stands in the rows: null for null, '(other)' for the rest."""
    return F.when(key == REST, "(other)").when(key != NULL_STRATUM, F.substring(key, 6, 1 << 30))


def unmet_needs(needs: list[int], there: list[dict[str, int]]) -> list[int]:
    """How much of each category's need no draw can meet: a max-flow from needs through the cells' rows.

    Source to category: its need; category to stratum: the rows of the cell; stratum to sink: all its
    rows. What the flow leaves of the first edges is missing.
    """
    strata = sorted({s for cells in there for s in cells})
    at = {s: len(needs) + k for k, s in enumerate(strata)}
    source, sink = len(needs) + len(strata), len(needs) + len(strata) + 1
    flow = Flow(sink + 1)
    wanted = [flow.add(source, i, need) for i, need in enumerate(needs)]
    for i, cells in enumerate(there):
        for s, n in cells.items():
            flow.add(i, at[s], n)
    for s in strata:
        flow.add(at[s], sink, sum(cells.get(s, 0) for cells in there))
    flow.run(source, sink)
    return [flow.edges[e][1] for e in wanted]


class QuotaPlan:
    """Integer quotas of every cell, and the report per target row."""

    def __init__(self, questions: DataFrame, targets: DataFrame, id_col: str = "question_id", stratum: str = "source", max_strata: int = 1000):
        self.spark, self.targets = questions.sparkSession, targets
        plan = [r.asDict() for r in targets.select("plan_id", "attribute", "category", "share_permille", "min_rows", "sample_rows").dropna(subset=["plan_id", "attribute", "category"]).collect()]
        self.rows = _expanded(questions, {r["attribute"] for r in plan}, id_col, stratum)
        named = self.spark.createDataFrame(sorted({(r["attribute"], r["category"]) for r in plan}), "attribute string, category string") if plan else None
        counts = self.rows.groupBy("attribute", "category", "stratum").agg(F.count("*").alias("n"))
        if named is not None:
            counts = counts.join(named, ["attribute", "category"], "left_semi")
            named_strata = [r["stratum"] for r in counts.filter("stratum is not null").groupBy("stratum").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "stratum").limit(max_strata).collect()]
            kept = spark_strata(self.spark, named_strata)
            self.rows, counts = self.rows.join(F.broadcast(kept), "stratum", "left"), counts.join(F.broadcast(kept), "stratum", "left")
            cells = counts.withColumn("stratum", cell_stratum()).groupBy("attribute", "category", "stratum").agg(F.sum("n").alias("n")).collect()
            self.rows = self.rows.withColumn("stratum", cell_stratum()).drop("is_named")
        else:
            cells = []
        there: dict[tuple, dict] = defaultdict(dict)
        for c in cells:
            there[c["attribute"], c["category"]][c["stratum"]] = c["n"]
        self.quotas, self.report_rows = [], []
        for pid in sorted({r["plan_id"] for r in plan}):
            own = [r for r in plan if r["plan_id"] == pid]
            have = [sum(there[r["attribute"], r["category"]].values()) for r in own]
            quota = category_quotas([r["share_permille"] or 0 for r in own], [r["min_rows"] or 0 for r in own], own[0]["sample_rows"] or 0, have)
            strata = sorted({s for r in own for s in there[r["attribute"], r["category"]]})
            table = [[Fraction(q * there[r["attribute"], r["category"]].get(s, 0), h) if h else Fraction(0) for s in strata] for r, q, h in zip(own, quota, have)]
            whole_cells = controlled_rounding(table)
            needs = [max(r["min_rows"] or 0, -(-(r["share_permille"] or 0) * (r["sample_rows"] or 0) // 1000)) for r in own]
            missing = unmet_needs(needs, [there[r["attribute"], r["category"]] for r in own])
            for r, need, lost, h, ints in zip(own, needs, missing, have, whole_cells):
                short = need - sum(ints)
                reason = "rows" if lost > 0 else None if short <= 0 else "minimum" if need == (r["min_rows"] or 0) else "rounding" if short == 1 else "other minima"
                self.report_rows.append((pid, r["attribute"], r["category"], need, h, sum(ints), lost, reason))
                self.quotas += [(pid, r["attribute"], r["category"], s, k) for s, k in zip(strata, ints) if k]

    def report(self) -> DataFrame:
        """plan_id, attribute, category, need, rows available, quota drawn, unmet (what no draw could reach), reason (why the quota is below the need, or null)."""
        return self.spark.createDataFrame(self.report_rows, "plan_id int, attribute string, category string, need bigint, available bigint, quota bigint, unmet bigint, reason string")

    def draw(self, seed: int = 146959810) -> DataFrame:
        """plan_id, attribute, category, stratum, row_id of the drawn rows, exactly the quota of each cell."""
        cells = self.spark.createDataFrame(self.quotas, "plan_id int, attribute string, category string, stratum string, quota bigint").withColumnRenamed("stratum", "stratum_key")
        keyed = (
            self.rows.withColumnRenamed("stratum", "stratum_key")
            .join(F.broadcast(cells) if len(self.quotas) <= 100_000 else cells, ["attribute", "category", "stratum_key"])
            .withColumn("key", F.xxhash64(F.lit(seed), "plan_id", "row_id"))
            .withColumn("prefix", F.shiftrightunsigned("key", 64 - PREFIX_BITS))
        )
        cell = ["plan_id", "attribute", "category", "stratum_key"]
        w = Window.partitionBy(*cell).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        edges = (
            keyed.groupBy(*cell, "quota", "prefix").agg(F.count("*").alias("n"))
            .withColumn("upto", F.sum("n").over(w))
            .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
            .select("plan_id", "attribute", "category", "stratum_key", F.col("prefix").alias("edge"), (F.col("quota") - F.col("upto") + F.col("n")).alias("still"))
            .collect()
        )  # fmt: skip  # one row a cell
        cut = self.spark.createDataFrame(edges, "plan_id int, attribute string, category string, stratum_key string, edge bigint, still bigint")
        found = keyed.join(F.broadcast(cut) if len(edges) <= 100_000 else cut, cell).filter(F.col("prefix") <= F.col("edge"))
        rank = F.row_number().over(Window.partitionBy(*cell, "prefix").orderBy("key", "row_id"))
        return found.withColumn("rank", rank).filter((F.col("prefix") < F.col("edge")) | (F.col("rank") <= F.col("still"))).select("plan_id", "attribute", "category", stratum_name(F.col("stratum_key")).alias("stratum"), "row_id")


def shortfalls(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Target rows whose need no draw can meet: what the max-flow through the cells' rows leaves of it."""
    return QuotaPlan(questions, targets).report().filter("unmet > 0").select("plan_id", "attribute", "category")


def below_need(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Target rows whose drawn quota is below their need, and why: too few rows, others' minima, or rounding."""
    return QuotaPlan(questions, targets).report().filter("reason is not null")


def draw_sample(questions: DataFrame, targets: DataFrame, seed: int = 146959810) -> DataFrame:
    """The drawn rows of all plans."""
    return QuotaPlan(questions, targets).draw(seed)
