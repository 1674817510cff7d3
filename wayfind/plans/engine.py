"""The engine of one catalog: keeps a published index up to date with the catalog, answers queries and says what it is doing.

An index is written to a folder of its own and then published as a file named by the next version, which one of several writers can create; the others take the version after it. Readers
take the highest version, so they never see half an index. An index is rebuilt when the catalog's signature is not the published one: at once, or in steps that go on in another session, too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import index as I  # noqa: E741
from wayfind.plans.search import explain, kept, parse_queries, search, search_compatible, warnings_of
from wayfind.sources.catalogs import write_xml
from wayfind.sources.settings import Settings
from wayfind.sources.workspace import create_once, exists, remove
from wayfind.streaming.sliced import SlicedBuild

#: Words for yes and no. Fixed values.
YES_NO = {"1": True, "true": True, "on": True, "sim": True, "0": False, "false": False, "off": False, "nao": False}
FAILURES, TOP = 3, 10
#: Settings that a user can switch by name. Fixed values.
OPTIONS = {"showReasons": "ui#showReasons", "incremental": "ui#incremental"}
#: Published versions whose tables are kept: the newest, and the one that readers may still be at.
VERSIONS = 2
PUBLISHED = "version long, path string, signature string, n_items long"


@dataclass
class Engine:
    """catalog: gives the catalog as it is now. second: gives (item_id, spec_id, value) for a list of spec ids that few items have."""

    spark: SparkSession
    folder: str
    catalog: Callable[[], DataFrame]
    locales: tuple[str, ...] = ("en",)
    spec_ids: tuple[str, ...] = ()
    second: Callable[[list[str]], DataFrame] | None = None
    state: str = "uninitialized"
    failures: int = 0
    index: I.Index | None = None
    version: int = 0
    low: list[str] = field(default_factory=list)
    slice_items: int = 200_000
    building: str | None = None

    def __post_init__(self) -> None:
        self.settings = Settings(self.spark, self.folder)

    # ---- lifecycle

    def published(self):
        """The newest published index as a row, or None."""
        try:
            return self.spark.read.schema(PUBLISHED).json(f"{self.folder}/published").orderBy(F.desc("version")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def is_busy(self) -> bool:
        """Whether a build is under way, be it between two steps."""
        return self.state == "indexing" or self.building is not None

    def _publish(self, path: str, index: I.Index) -> None:
        """As the version after the newest; if another engine was faster, as the one after that."""
        meta = index.meta.first()
        while True:
            last = self.published()
            version = (last["version"] if last else 0) + 1
            row = {"version": version, "path": path, "signature": meta["signature"], "n_items": meta["n_items"]}
            if create_once(self.spark, f"{self.folder}/published", f"v{version:012d}.json", json.dumps(row) + "\n"):
                break
        self.version, self.index, self.state, self.failures = version, index, "ready", 0
        for old in self.spark.read.schema(PUBLISHED).json(f"{self.folder}/published").where(F.col("version") == version - VERSIONS).collect():
            I.Index.forget(self.spark, old["path"])
            remove(self.spark, old["path"])

    def _written(self, built: I.Index, fields: DataFrame | None = None) -> None:
        path = f"{self.folder}/index-{uuid.uuid4().hex}"
        coverage = I.low_specs(I.spec_coverage(built.items, built.numeric, list(self.spec_ids))) if self.spec_ids else None
        self.low = sorted(r["spec_id"] for r in coverage.collect()) if coverage is not None else []  # at most the asked specs
        self._publish(path, built.write(path, self.second(self.low) if self.second and self.low else None, fields))

    def ensure(self) -> I.Index | None:
        """The index of the catalog as it is; built anew only if the catalog has changed. None once the engine has failed too often."""
        if self.state == "degraded":
            return None
        now = self.published()
        if now is None or now["signature"] != I.signature_of(self.catalog()).first()["signature"]:
            return self.rebuild()
        if self.index is None or self.version != now["version"]:
            self.index, self.version, self.state = I.Index.read(self.spark, now["path"]), now["version"], "ready"
        return self.index

    def rebuild(self) -> I.Index | None:
        """Builds and publishes, whatever is published. A failure leaves the last index in use; the third in a row ends the engine's work."""
        before, self.state = self.state, "indexing"
        try:
            self._written(I.build_index(self.catalog()))
        except Exception:
            self._failed(before)
            raise
        return self.index

    def _failed(self, before: str) -> None:
        self.failures += 1
        self.state = "degraded" if self.failures >= FAILURES else before

    def step(self, budget: float | None = None) -> bool:
        """Works on the index of the catalog as it is for about ``budget`` seconds, a slice at least. Whether work is left. A build that this or another engine on the folder has begun is gone on
        with; if the catalog has changed since, it is given up and another begins. The last index stays in use until the new one is published."""
        if self.state == "degraded":
            return False
        now, wanted = self.published(), I.signature_of(self.catalog()).first()["signature"]
        if now is not None and now["signature"] == wanted:
            self._give_up()
            self.ensure()
            return False
        path, before = f"{self.folder}/builds/{wanted.replace(':', '-')}", self.state
        if self.building not in (None, path):
            self._give_up()
        self.building, self.state = path, "indexing"
        try:
            build = SlicedBuild(self.spark, path, self.catalog, self.slice_items)
            if not build.step(budget):
                self.state = before
                return True
            self._written(*build.parts())
        except Exception:
            self._failed(before)
            raise
        self._give_up()
        return False

    def _give_up(self) -> None:
        """Removes what a build has written on its way."""
        if self.building is not None and exists(self.spark, self.building):
            remove(self.spark, self.building)
        self.building = None

    def release(self) -> None:
        self.index, self.state = None, "uninitialized"

    # ---- questions

    def _asked(self, text: str) -> DataFrame:
        return kept(parse_queries(self.spark.createDataFrame([(1, text)], "query_id long, text string"), self.locales))

    def status(self) -> dict:
        return {"state": self.state, "version": self.version, "n_items": self.index.items.count() if self.index else 0, "failures": self.failures, "low_specs": self.low}

    def search(self, text: str) -> tuple[DataFrame, DataFrame]:
        """(results, warnings): at most as many results as the settings allow, with lines of reasons if they are to be shown."""
        index, parsed = self.ensure(), self._asked(text)
        most = int(self.settings.get("search#maxResults"))
        found = explain(index, parsed, most=most) if self.option("showReasons") else search(index, parsed, most=most)
        return found.orderBy("rank"), warnings_of(index, parsed)

    def explain_query(self, text: str, top: int = TOP) -> tuple[DataFrame, DataFrame]:
        """What the text was understood as, and its first results with their reasons."""
        parsed = self._asked(text)
        return parsed, explain(self.ensure(), parsed, most=top).orderBy("rank")

    def explain_item(self, key: str, text: str) -> DataFrame:
        """The reasons of one item, if it is among the results."""
        return explain(self.ensure(), self._asked(text)).where(F.col("key") == key)

    def compatible(self, text: str, vehicles: DataFrame, implements: DataFrame, selected_key: str | None = None) -> DataFrame:
        selected = self.spark.createDataFrame([(1, selected_key)], "query_id long, key string") if selected_key else None
        return search_compatible(self.ensure(), self._asked(text), vehicles, implements, selected)

    def dump(self, path: str) -> None:
        write_xml(self.catalog(), path)

    def set_option(self, name: str, word: str) -> bool:
        """Stores a switch beside the index, where other engines on the folder find it."""
        if name not in OPTIONS:
            raise KeyError(f"unknown option {name}: one of {', '.join(OPTIONS)}")
        if (value := YES_NO.get(str(word).lower())) is None:
            raise ValueError(f"{name} is one of {', '.join(YES_NO)}")
        self.settings.set(OPTIONS[name], value)
        return value

    def option(self, name: str) -> bool:
        return self.settings.get(OPTIONS[name])


@dataclass
class SearchState:
    """What a user has typed and chosen."""

    text: str = ""
    chosen: dict = field(default_factory=dict)
    context: str | None = None
    previous_category: str | None = None

    def is_active(self) -> bool:
        return bool(self.text.strip() or self.chosen or self.context)

    def clear(self) -> None:
        self.text, self.chosen, self.context = "", {}, None
