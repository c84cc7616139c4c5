"""Two spellings of one SQL text: Spark's, which runs, and DuckDB's, which checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def pick(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def days(self, a: str, b: str) -> str:
        """Whole days from a to b, as dates."""
        return self.pick(f"datediff(CAST({b} AS DATE), CAST({a} AS DATE))", f"date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE))")

    def months(self, a: str, b: str) -> str:
        """Difference of calendar months from a to b."""
        return f"((year({b}) * 12 + month({b})) - (year({a}) * 12 + month({a})))"

    def seconds(self, a: str, b: str) -> str:
        return self.pick(f"(unix_micros(CAST({b} AS TIMESTAMP)) - unix_micros(CAST({a} AS TIMESTAMP))) / 1000000.0D", f"(epoch_us({b}) - epoch_us({a})) / 1000000.0::DOUBLE")

    def idiv(self, a: str, b: str) -> str:
        return self.pick(f"(({a}) div ({b}))", f"(({a}) // ({b}))")

    def trunc(self, unit: str, x: str) -> str:
        return f"CAST(date_trunc('{unit}', {x}) AS DATE)"

    def add_months(self, x: str, n: int) -> str:
        return self.pick(f"add_months({x}, {n})", f"CAST({x} + INTERVAL {n} MONTH AS DATE)")

    def add_days(self, x: str, n: int) -> str:
        return self.pick(f"date_add({x}, {n})", f"CAST({x} + INTERVAL {n} DAY AS DATE)")

    def months_between(self, a: str, b: str) -> str:
        """A relation of the month starts from a to b: column m."""
        return self.pick(f"SELECT explode(sequence(DATE'{a}', DATE'{b}', INTERVAL 1 MONTH)) AS m", f"SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 MONTH)) AS DATE) AS m")

    def json(self, column: str, key: str) -> str:
        return self.pick(f"get_json_object({column}, '$.{key}')", f"json_extract_string({column}, '$.{key}')")

    def money(self, x: str) -> str:
        """Exact sums: four decimal places."""
        return f"CAST({x} AS DECIMAL(18, 4))"

    def real(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def share(self, a: str, b: str, digits: int = 6) -> str:
        """a / b as a double, null where b is 0."""
        return f"ROUND(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), {digits})"


SPARK, DUCK = Dialect(True), Dialect(False)
Text = Callable[[Dialect], str]
