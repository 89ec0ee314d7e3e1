"""Declares an operator together with the columns it reads."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from datetime import date
from typing import Any

from pyspark.sql import DataFrame

Tables = Mapping[str, DataFrame]


class Operator:
    """``op(tables, as_of=..., **params) -> DataFrame`` over named input tables.

    ``reads`` names the columns used from each table. They are selected before the body runs, so
    scans stay narrow, and a table provider can leave out joins that only feed other columns.
    ``instead`` names, for a table, a summary of it that is read in its place where it is given.
    """

    def __init__(self, body: Callable[..., DataFrame], reads: dict[str, tuple[str, ...]], instead: dict[str, tuple[str, tuple[str, ...]]]):
        self.body = body
        self.reads = reads
        self.instead = instead
        self.name = body.__name__
        self.__doc__ = body.__doc__
        self._takes_date = "as_of" in inspect.signature(body).parameters

    def __call__(self, tables: Tables, *, as_of: date | None = None, **params: Any) -> DataFrame:
        if self._takes_date:
            if as_of is None:
                raise ValueError(f"{self.name} needs as_of")
            params["as_of"] = as_of
        return self.body({t: self._narrow(tables, t, cols) for t, cols in self.reads.items()}, **params)

    def _narrow(self, tables: Tables, table: str, columns: tuple[str, ...]) -> DataFrame:
        summary, its_columns = self.instead.get(table, (None, ()))
        return tables[summary].select(*its_columns) if summary in tables else tables[table].select(*columns)


def operator(instead: Mapping[str, tuple[str, str]] | None = None, **reads: str) -> Callable[[Callable[..., DataFrame]], Operator]:
    """``@operator(sales="date sku_id")`` declares that the operator reads those columns, and
    ``instead={"sales": ("sales_by_day", "date sku_id")}`` that a table of that name may stand in."""
    columns = {table: tuple(names.split()) for table, names in reads.items()}
    others = {table: (name, tuple(names.split())) for table, (name, names) in (instead or {}).items()}
    return lambda body: Operator(body, columns, others)
