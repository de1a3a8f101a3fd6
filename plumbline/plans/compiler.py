"""Programs to DataFrames.

A set step becomes a relation: a DataFrame whose column s<i> holds the step's value and that keeps the s-columns of the
steps it comes from (its lineage). `#1 where #2 ...` is therefore a filter on the row that carries both, if #2 comes from
#1, or a join on an ancestor that both have. A scalar step is a column: an aggregate is a scalar subquery, so one row is
compared without a join. Everything is one lazy plan for Catalyst; columns that no step names are pruned in the scans.

Ties of a superlative are all kept. A comparison of equal values is unresolved (null) for two steps; among more the first
of the equal smallest and the last of the equal largest stand. Booleans are 'yes' and 'no'.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.sampling import positions
from plumbline.plans import grounding as g
from plumbline.plans.program import Program, Step, comparator, parse

AGG = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "count": F.count}


@dataclass
class Rel:
    df: DataFrame
    col: str
    entity: str | None = None
    lineage: tuple[str, ...] = ()


class Compiler:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.done = spark, sf_dir, {}

    def table(self, entity: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{g.SCHEMA[entity].table}.parquet")

    def compile(self, program: Program | str) -> DataFrame:
        """The last step's result as column `answer` (and `entity`, the key it belongs to, if it is an attribute of one)."""
        program = parse(program) if isinstance(program, str) else program
        self.done = {}
        for i, step in enumerate(program.steps, 1):
            if step.op is None:
                raise g.Ungrounded(f"step {i} is not recognised: {step.text!r}")
            self.done[f"#{i}"] = getattr(self, f"_{step.op}")(step, f"s{i}")
        last = self.done[f"#{len(program.steps)}"]
        if isinstance(last, Column):
            return self.spark.range(1).select(last.alias("answer"))
        keys = [c for c in last.lineage if (r := self.done[f"#{c[1:]}"]) and isinstance(r, Rel) and r.entity is not None]
        key = keys[-1] if keys and last.entity is None else None
        extra = [F.col("position")] if "position" in last.df.columns else []
        return last.df.select(*([F.col(key).alias("entity")] if key else []), F.col(last.col).alias("answer"), *extra)

    # ---- sets

    def _select(self, step: Step, s: str) -> Rel:
        entity = g.entity_of(step.args[0])
        return Rel(self.table(entity).withColumn(s, F.col(g.SCHEMA[entity].key)), s, entity)

    def _filter(self, step: Step, s: str) -> Rel:
        base, phrase = self.done[step.args[0]], step.args[1]
        if (m := re.search(r"#(\d+)$", phrase)) and isinstance(other := self.done[f"#{m[1]}"], Rel):
            shared = base.col if base.col in (other.lineage or ()) or other.col == base.col else next(c for c in reversed((*base.lineage, base.col)) if c in (*other.lineage, other.col))
            return self._again(base, base.df.join(other.df.select(shared).distinct(), shared, "left_semi"), s)
        if base.entity is None:
            op, value = comparator(phrase)
            return self._again(base, base.df.where(g.compared(F.col(base.col), op, value)), s)
        column, value = g.filter_of(base.entity, phrase)
        return self._again(base, base.df.where(F.col(column) == g.value_of(value)), s)

    def _again(self, base: Rel, df: DataFrame, s: str) -> Rel:
        """The same things, fewer of them, as a step of its own."""
        return Rel(df.withColumn(s, F.col(base.col)), s, base.entity, (*base.lineage, base.col))

    def _project(self, step: Step, s: str) -> Rel:
        phrase, base = step.args[0], self.done[step.args[1]]
        name = re.sub(r"\s*(?:of|in|for) #REF$", "", phrase).strip()
        found = g.attribute_of(base.entity, name)
        lineage = (*base.lineage, base.col)
        if isinstance(found, str):
            return Rel(base.df.withColumn(s, F.col(found)), s, None, lineage)
        entity, own, other = found
        right = self.table(entity)
        kept = base.df.select(*lineage, *[c for c in base.df.columns if c == own and c not in lineage])
        return Rel(kept.join(right, kept[own] == right[other]).withColumn(s, right[g.SCHEMA[entity].key]), s, entity, lineage)

    def _aggregate(self, step: Step, s: str) -> Column | Rel:
        how, base = step.args[0], self.done[step.args[1]]
        if top := re.fullmatch(r"top (\d+)", how):
            return Rel(base.df.orderBy(F.col(base.col).desc_nulls_last(), *base.lineage).limit(int(top[1])).withColumn(s, F.col(base.col)), s, None, base.lineage)
        return base.df.agg(AGG[how](base.col)).scalar()

    def _group(self, step: Step, s: str) -> Rel:
        how, value, key = step.args
        value, key = self.done[value], self.done[key]
        summed = value.df.groupBy(key.col).agg(AGG[how](value.col).alias(s))
        out = key.df.join(summed, key.col, "left")
        if how == "count":
            out = out.withColumn(s, F.coalesce(s, F.lit(0)))
        return Rel(out, s, None, (*key.lineage, key.col))

    def _paired(self, entity: Rel, attribute: Rel) -> DataFrame:
        """Rows that carry the entity and the attribute."""
        if entity.col in (*attribute.lineage, attribute.col):
            return attribute.df
        shared = next(c for c in reversed((*entity.lineage, entity.col)) if c in (*attribute.lineage, attribute.col))
        return entity.df.join(attribute.df.select(shared, attribute.col).distinct(), shared)

    def _narrowed(self, entity: Rel, rows: DataFrame, s: str) -> Rel:
        """The entity's rows that are still there; its own columns when rows come from another relation."""
        kept = entity.df.join(rows.select(entity.col).distinct(), entity.col, "left_semi")
        return self._again(entity, kept, s)

    def _superlative(self, step: Step, s: str) -> Rel:
        how, entity, attribute = step.args[0], self.done[step.args[1]], self.done[step.args[2]]
        rows = self._paired(entity, attribute)
        if top := re.fullmatch(r"top (\d+)", how):
            return self._narrowed(entity, rows.orderBy(F.col(attribute.col).desc_nulls_last(), entity.col).limit(int(top[1])), s)
        best = rows.agg(AGG[how](attribute.col)).scalar()
        return self._narrowed(entity, rows.where(F.col(attribute.col) == best), s)

    def _comparative(self, step: Step, s: str) -> Rel:
        entity, attribute, condition = self.done[step.args[0]], self.done[step.args[1]], step.args[2]
        rows = self._paired(entity, attribute)
        op, value = comparator(condition)
        if (m := re.search(r"#(\d+)", condition)) and isinstance(other := self.done[m[0]], Column):
            value = other
        return self._narrowed(entity, rows.where(g.compared(F.col(attribute.col), op, value if value is not None else condition)), s)

    def _union(self, step: Step, s: str) -> Rel | Column:
        parts = [self.done[r] for r in step.args]
        if all(isinstance(p, Column) for p in parts):
            return F.array(*[p.cast("string") for p in parts])
        out = parts[0].df.select(F.col(parts[0].col).alias(s))
        for p in parts[1:]:
            out = out.unionByName(p.df.select(F.col(p.col).alias(s)))
        return Rel(out, s, parts[0].entity if len({p.entity for p in parts}) == 1 else None)

    def _intersection(self, step: Step, s: str) -> Rel:
        parts = [self.done[r] for r in step.args[1:]]
        out = parts[0].df.select(F.col(parts[0].col).alias(s))
        for p in parts[1:]:
            out = out.intersect(p.df.select(F.col(p.col).alias(s)))
        return Rel(out.distinct(), s, parts[0].entity)

    def _discard(self, step: Step, s: str) -> Rel:
        base, other = self.done[step.args[0]], step.args[1]
        if other not in self.done:
            column = base.col if base.entity is None else g.SCHEMA[base.entity].attributes["name"]
            return self._again(base, base.df.where(F.col(column) != g.value_of(other)), s)
        gone = self.done[other]
        column = gone.col if gone.entity == base.entity else base.col
        return self._again(base, base.df.join(gone.df.select(F.col(column).alias("_gone")).distinct(), F.col(base.col) == F.col("_gone"), "left_anti"), s)

    def _sort(self, step: Step, s: str) -> Rel:
        """Rows in order. The position is dealt out only here, where an order over all rows is what is asked for, by parts of
        the order whose bounds are looked up first."""
        base, order = self.done[step.args[0]], self.done[step.args[1].split()[0]]
        rows = self._paired(base, order)
        out = rows.select(*dict.fromkeys([*base.lineage, base.col, order.col])).distinct()
        out = positions(out, [order.col, base.col])
        return Rel(out.withColumn(s, F.col(base.col)), s, base.entity, (*base.lineage, base.col))

    # ---- scalars

    def _yes(self, condition: Column) -> Column:
        return F.when(condition, F.lit("yes")).when(~condition, F.lit("no"))

    def _scalar(self, ref: str) -> Column:
        found = self.done[ref]
        return found if isinstance(found, Column) else found.df.agg(F.min(found.col)).scalar()

    def _boolean(self, step: Step, s: str) -> Column:
        a = step.args
        if a[0] in ("logical_and", "logical_or"):
            is_so = [self._scalar(r) == F.lit("yes" if a[1] == "true" else "no") for r in a[2:]]
            return self._yes(is_so[0] & is_so[1] if a[0] == "logical_and" else is_so[0] | is_so[1])
        if a[0] == "if_exist":
            base, other = self.done[a[1]], self.done[re.search(r"#\d+", a[2])[0]]
            return self._yes(base.df.join(other.df.select(F.col(other.col).alias("_o")).distinct(), F.col(base.col) == F.col("_o"), "left_semi").agg(F.count("*") > 0).scalar())
        base = self.done[a[0]]
        op, value = comparator(a[1])
        if m := re.search(r"#(\d+)", a[1]):
            value = self._scalar(m[0])
        if isinstance(base, Column):
            return self._yes(g.compared(base, op, value))
        if base.entity is not None:  # `if #1 from segment X`: some of them are
            column, wanted = g.filter_of(base.entity, a[1])
            return self._yes(base.df.where(F.col(column) == g.value_of(wanted)).agg(F.count("*") > 0).scalar())
        return self._yes(base.df.agg(F.bool_and(g.compared(F.col(base.col), op, value))).scalar())

    def _arithmetic(self, step: Step, s: str) -> Column:
        op, *refs = step.args
        x = [self._scalar(r).cast("double") for r in refs]
        out = x[0]
        for y in x[1:]:
            out = {"sum": out + y, "difference": out - y, "multiplication": out * y, "division": F.try_divide(out, y)}[op]
        return F.abs(out) if op == "difference" else out

    def _comparison(self, step: Step, s: str) -> Column:
        how, *refs = step.args
        x = [self._scalar(r) for r in refs]
        if how in ("true", "false"):
            wanted = "yes" if how == "true" else "no"
            return F.array_join(F.filter(F.array(*[F.when(v == wanted, F.lit(r)) for r, v in zip(refs, x, strict=True)]), lambda e: e.isNotNull()), ",")
        best = (F.least if how == "min" else F.greatest)(*x)
        order = list(zip(refs, x, strict=True)) if how == "min" else list(zip(refs, x, strict=True))[::-1]
        out = F.lit(None).cast("string")
        for r, v in reversed(order):
            out = F.when(v == best, F.lit(r)).otherwise(out)
        return F.when(F.least(*x) == F.greatest(*x), F.lit(None)).otherwise(out)


def answer(spark: SparkSession, sf_dir: str, program: Program | str) -> DataFrame:
    return Compiler(spark, sf_dir).compile(program)
