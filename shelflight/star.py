"""The six normalised tables as one handle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.schemas import TABLES

# In facts that are cut at the same bounds: the number of a record's range.
RANGE = "fact_range"


class Star:
    """Stores, products, seasonality, inventory, pricing and store events.

    Each table is given as a DataFrame or as a function that builds one. A
    function is called when its table is first used, so a report pays only for
    the plans it reads.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"not a table of the model: {sorted(unknown)}")
        self._tables = dict(tables)
        self._derived: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"this star has no {name} table")
        given = self._tables[name]
        if not isinstance(given, DataFrame):
            given = given()
            self._tables[name] = given
        return given

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table computed from this star, built once for all reports that ask for it."""
        if name not in self._derived:
            self._derived[name] = build()
        return self._derived[name]

    def known(self, name: str) -> DataFrame | None:
        """A derived table if this star has it already."""
        return self._derived.get(name)

    def sliced(self, product_id: str | None = None, store_region_id: str | None = None) -> Star:
        """This star with the rows of one product and/or one store-region only.

        Reports on it compute no other group. Thresholds are per store-product, so a
        sliced report has the rows of the whole one, except where a report compares
        stores or regions with each other.
        """
        wanted = {"product_id": product_id, "store_region_id": store_region_id}

        def cut(name: str) -> Callable[[], DataFrame]:
            def build() -> DataFrame:
                table = self.table(name)
                for column, value in wanted.items():
                    if value is not None and column in table.columns:
                        table = table.where(F.col(column) == value)
                return table

            return build

        return Star(**{name: cut(name) for name in self._tables})

    @property
    def stores(self) -> DataFrame:
        return self.table("stores")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def seasonality(self) -> DataFrame:
        return self.table("seasonality")

    @property
    def inventory(self) -> DataFrame:
        return self.table("inventory")

    @property
    def pricing(self) -> DataFrame:
        return self.table("pricing")

    @property
    def store_events(self) -> DataFrame:
        return self.table("store_events")
