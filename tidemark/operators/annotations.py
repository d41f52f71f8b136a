"""Labels and notes on rows: an immutable store whose records are a DataFrame, whatever their number.

``labels`` is a small catalogue on the driver, in order. ``records`` has (row_id, label_ids, note, updated_at); a record
without labels and note does not exist. Each change gives a new store.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sidefiles import SharedFiles

DEFAULT_COLOR = "#8899ff"
EXPORT_VERSION = 1
RECORD_DDL = "row_id long, label_ids array<string>, note string, updated_at long"

# The ids, names and colours of the default label catalogue.
DEFAULT_LABELS = (
    ("mitre-ta0043-reconnaissance", "Reconnaissance", "#64748b"),
    ("mitre-ta0042-resource-development", "Resource Development", "#0f766e"),
    ("mitre-ta0001-initial-access", "Initial Access", "#b45309"),
    ("mitre-ta0002-execution", "Execution", "#c2410c"),
    ("mitre-ta0003-persistence", "Persistence", "#7c3aed"),
    ("mitre-ta0004-privilege-escalation", "Privilege Escalation", "#be123c"),
    ("mitre-ta0005-defense-evasion", "Defense Evasion", "#1d4ed8"),
    ("mitre-ta0006-credential-access", "Credential Access", "#b91c1c"),
    ("mitre-ta0007-discovery", "Discovery", "#0891b2"),
    ("mitre-ta0008-lateral-movement", "Lateral Movement", "#0369a1"),
    ("mitre-ta0009-collection", "Collection", "#65a30d"),
    ("mitre-ta0011-command-and-control", "Command and Control", "#7c2d12"),
    ("mitre-ta0010-exfiltration", "Exfiltration", "#db2777"),
    ("mitre-ta0040-impact", "Impact", "#991b1b"),
)


def _now() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class Label:
    id: str
    name: str
    color: str = DEFAULT_COLOR
    description: str | None = None
    created_at: int = 0
    updated_at: int = 0


def default_labels() -> tuple[Label, ...]:
    return tuple(Label(*row) for row in DEFAULT_LABELS)


def clean_ids(ids: Iterable[Any] | None) -> list[str]:
    """Trimmed texts, each once, in order; blanks and what is no text are dropped."""
    return list(dict.fromkeys(i.strip() for i in ids or () if isinstance(i, str) and i.strip()))


def read_label(raw: Mapping[str, Any], now: int) -> Label:
    text = lambda key, other: raw[key].strip() if isinstance(raw.get(key), str) and raw[key].strip() else other
    when = lambda *keys: next((int(raw[k]) for k in keys if isinstance(raw.get(k), (int, float)) and not isinstance(raw[k], bool)), now)
    return Label(text("id", None) or uuid.uuid4().hex, text("name", "Untitled label"), text("color", DEFAULT_COLOR), text("description", None), when("createdAt", "created_at"), when("updatedAt", "updated_at"))


class InvalidExport(ValueError):
    """The file is no export of annotations."""


@dataclass(frozen=True)
class TagStore:
    labels: tuple[Label, ...]
    records: DataFrame

    # --- making one ---------------------------------------------------------------------------------------------
    @classmethod
    def empty(cls, spark: SparkSession, labels: Sequence[Label] | None = None) -> "TagStore":
        """Without a catalogue of its own a store begins with the default one; an empty one stays empty."""
        return cls(default_labels() if labels is None else tuple(labels), spark.createDataFrame([], RECORD_DDL))

    @classmethod
    def of(cls, labels: Sequence[Label], records: DataFrame) -> "TagStore":
        store = cls(tuple(labels), records)
        return store._with(records)

    @property
    def _ids(self) -> Column:
        return F.array(*(F.lit(x.id) for x in self.labels)).cast("array<string>")

    def _with(self, records: DataFrame) -> "TagStore":
        """Records as they may be kept: known labels, notes with text, and something in them."""
        known = F.array_intersect(F.coalesce("label_ids", F.array().cast("array<string>")), self._ids)
        kept = records.select("row_id", known.alias("label_ids"), F.when(F.col("note") != "", F.col("note")).alias("note"), "updated_at")
        return replace(self, records=kept.where((F.size("label_ids") > 0) | F.col("note").isNotNull()))

    def _rows(self, rows: Iterable[int] | DataFrame) -> DataFrame:
        """Ids as a one-column DataFrame ``row_id``, without what is no id."""
        if isinstance(rows, DataFrame):
            return rows.select(F.col(rows.columns[0]).cast("long").alias("row_id")).where("row_id >= 0").distinct()
        good = sorted({int(r) for r in rows if isinstance(r, (int, float)) and r == r and abs(r) != float("inf") and r >= 0})
        return self.records.sparkSession.createDataFrame([(r,) for r in good], "row_id long")

    # --- records ------------------------------------------------------------------------------------------------
    def tag(self, rows: Iterable[int] | DataFrame, labels: Sequence[str] | None | type(...) = ..., note: str | None = None, mode: str = "replace", now: int | None = None) -> "TagStore":
        """Change the records of ``rows``. Labels left out stay, None clears them; a note of None stays, ``''`` clears it."""
        if mode not in ("replace", "append", "remove"):
            raise ValueError(f"unknown mode {mode!r}")
        changed = self._rows(rows).withColumn("__tm_new", F.lit(True))
        held = F.coalesce("label_ids", F.array().cast("array<string>"))
        if labels is ...:
            after = held
        else:
            given = F.array(*(F.lit(i) for i in clean_ids(labels))).cast("array<string>")
            after = {"replace": given, "append": F.array_union(held, given), "remove": F.array_except(held, given)}["replace" if labels is None else mode]
        new = F.col("__tm_new").isNotNull()
        out = self.records.join(changed, "row_id", "full").select(
            "row_id",
            F.when(new, after).otherwise(held).alias("label_ids"),
            F.when(new, F.lit(note)).otherwise(F.col("note")).alias("note") if note is not None else F.col("note"),
            F.when(new, F.lit(_now() if now is None else now)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"),
        )
        return self._with(out)

    def clear(self, rows: Iterable[int] | DataFrame) -> "TagStore":
        return replace(self, records=self.records.join(self._rows(rows), "row_id", "left_anti"))

    # --- catalogue ----------------------------------------------------------------------------------------------
    def upsert_label(self, label: Label, now: int | None = None) -> "TagStore":
        """The label in place of the one with its id, which lends its time of creation, or at the end."""
        now = _now() if now is None else now
        old = next((x for x in self.labels if x.id == label.id), None)
        made = Label(label.id, label.name.strip() or "Untitled label", (label.color or "").strip() or DEFAULT_COLOR, label.description, old.created_at if old else label.created_at or now, now)
        return replace(self, labels=tuple(made if x.id == label.id else x for x in self.labels) if old else (*self.labels, made))

    def delete_label(self, label_id: str, now: int | None = None) -> "TagStore":
        """Also off all records; notes stay."""
        if all(x.id != label_id for x in self.labels):
            return self
        rest = replace(self, labels=tuple(x for x in self.labels if x.id != label_id))
        touched = F.array_contains("label_ids", label_id)
        when = F.when(touched, F.lit(_now() if now is None else now)).otherwise(F.col("updated_at")).cast("long")
        return rest._with(self.records.select("row_id", F.array_remove("label_ids", label_id).alias("label_ids"), "note", when.alias("updated_at")))

    # --- export and import ----------------------------------------------------------------------------------------
    def import_records(self, labels: Sequence[Label], records: DataFrame, strategy: str = "merge") -> "TagStore":
        """Incoming labels win by id, incoming records replace a row's labels; a note that does not come along stays.

        ``replace`` forgets what was there before.
        """
        if strategy not in ("merge", "replace"):
            raise ValueError(f"unknown strategy {strategy!r}")
        known = {x.id: x for x in self.labels} if strategy == "merge" else {}
        known |= {x.id: x for x in labels}
        out = replace(self, labels=tuple(known.values()))
        if strategy == "replace":
            return out._with(records)
        new = records.select("row_id", F.col("label_ids").alias("l"), F.col("note").alias("n"), F.col("updated_at").alias("u"), F.lit(True).alias("__tm_new"))
        came = F.col("__tm_new").isNotNull()
        merged = self.records.join(new, "row_id", "full").select(
            "row_id", F.when(came, F.col("l")).otherwise(F.col("label_ids")).alias("label_ids"),
            F.when(came, F.coalesce("n", "note")).otherwise(F.col("note")).alias("note"), F.when(came, F.col("u")).otherwise(F.col("updated_at")).alias("updated_at"),
        )
        return out._with(merged)

    def snapshot(self) -> dict[str, Any]:
        """Everything, on the driver: what people have tagged by hand is small."""
        label = lambda x: {k: v for k, v in (("id", x.id), ("name", x.name), ("color", x.color), ("description", x.description), ("createdAt", x.created_at), ("updatedAt", x.updated_at)) if v is not None}
        tags = {}
        for r in self.records.orderBy("row_id").toLocalIterator():
            tags[str(r.row_id)] = {"labelIds": list(r.label_ids), "updatedAt": r.updated_at} | ({"note": r.note} if r.note is not None else {})
        return {"labels": [label(x) for x in self.labels], "tags": tags}

    def export(self, source: Mapping[str, Any] | None = None, now: int | None = None) -> dict[str, Any]:
        out = {"version": EXPORT_VERSION, "exportedAt": _now() if now is None else now, "payload": self.snapshot()}
        return out | ({"source": dict(source)} if source else {})

    def import_(self, payload: Any, strategy: str = "merge", now: int | None = None) -> "TagStore":
        """An export's envelope, or its payload alone, or either as JSON text."""
        now = _now() if now is None else now
        labels, rows = parse_export(payload, now)
        return self.import_records(labels, self.records.sparkSession.createDataFrame(rows, RECORD_DDL), strategy)

    def save(self, path: str, now: int | None = None) -> None:
        """The envelope as a JSON file on the file system that the cluster shares; see :class:`SharedFiles`."""
        SharedFiles(self.records.sparkSession).write(path, json.dumps(self.export(now=now), ensure_ascii=False))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TagStore":
        """A saved store; without a file one with the default catalogue."""
        text = SharedFiles(spark).read(path)
        return cls.empty(spark) if text is None else cls.empty(spark, ()).import_(text, "replace")

    # --- reading ------------------------------------------------------------------------------------------------
    def label_names(self) -> dict[str, str]:
        return {x.id: x.name for x in self.labels}

    def cells(self) -> DataFrame:
        """(row_id, labels array<struct<id, name, color>>, note) as a grid shows them; blank notes are none."""
        shown = F.create_map(*(v for x in self.labels for v in (F.lit(x.id), F.struct(F.lit(x.id).alias("id"), F.lit(x.name).alias("name"), F.lit(x.color).alias("color"))))) if self.labels else None
        labels = F.transform("label_ids", lambda i: F.element_at(shown, i)) if self.labels else F.array().cast("array<struct<id:string,name:string,color:string>>")
        note = F.when(F.trim("note") != "", F.col("note"))
        return self.records.select("row_id", labels.alias("labels"), note.alias("note")).where((F.size("labels") > 0) | F.col("note").isNotNull())


def _is_snapshot(value: Any) -> bool:
    if not isinstance(value, dict) or not isinstance(value.get("labels"), list) or not isinstance(value.get("tags"), dict):
        return False
    good_label = lambda x: isinstance(x, dict) and all(isinstance(x.get(k), str) for k in ("id", "name", "color"))
    good_tag = lambda x: x is None or (isinstance(x, dict) and (isinstance(x.get("labelIds"), list) or isinstance(x.get("labelId"), (str, type(None)))))
    return all(map(good_label, value["labels"])) and all(map(good_tag, value["tags"].values()))


def parse_export(value: Any, now: int) -> tuple[list[Label], list[tuple]]:
    """Labels and records of an export; old records with one ``labelId`` are read too."""
    if isinstance(value, (str, bytes)):
        try:
            value = json.loads(value)
        except ValueError as e:
            raise InvalidExport("not JSON") from e
    if not _is_snapshot(value):
        if not isinstance(value, dict) or "payload" not in value:
            raise InvalidExport("not an export of annotations")
        if value.get("version") != EXPORT_VERSION:
            raise InvalidExport("unsupported version of an export")
        value = value["payload"]
        if not _is_snapshot(value):
            raise InvalidExport("the export's payload is invalid")
    rows = []
    for key, record in value["tags"].items():
        if not record or not str(key).isdigit():
            continue
        ids = clean_ids(record.get("labelIds")) or clean_ids([record.get("labelId")])
        when = record.get("updatedAt")
        rows.append((int(key), ids, record["note"] if isinstance(record.get("note"), str) else None, int(when) if isinstance(when, (int, float)) else now))
    return [read_label(x, now) for x in value["labels"]], rows

