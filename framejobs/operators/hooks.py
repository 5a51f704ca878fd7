"""User-supplied scorers: a function over Arrow batches takes the place of a raw table, under a checked contract.

A hook gets record batches of an input table and gives back the rows of one raw table. Its contract names the columns it
reads and the exact columns it must give; it is checked on an empty batch before any task runs, and on every batch while
they run. A hook may give several rows for an image or none, but never rows of an image it was not asked about.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Hook = Callable[[pa.RecordBatch], pa.RecordBatch]


class ContractError(ValueError):
    """A hook reads or gives something else than its contract says."""


@dataclass(frozen=True)
class Contract:
    """``reads``: columns of the input; ``gives``: the raw table's columns with types; ``key`` is in both."""

    reads: tuple[str, ...]
    gives: str
    key: str = "source_hash"

    def output(self) -> StructType:
        return StructType.fromDDL(self.gives)


#: The raw tables a hook may replace.
_ON_CANVAS = "scale double, pad_x double, pad_y double, scale_x double, scale_y double, source_width double, source_height double"
GIVES = {
    "pose": f"source_hash string, anchor_index int, channels array<double>, {_ON_CANVAS}",
    "face": "source_hash string, anchor_index int, stride int, cell_index int, score double, distances array<double>, "
            f"offsets array<double>, {_ON_CANVAS}",
    "mask": "source_hash string, kind string, width int, height int, data array<smallint>",
    "parse": "source_hash string, width int, height int, scale_x double, scale_y double, data array<smallint>, confidence array<double>",
}


def _shape(schema: pa.Schema) -> list[tuple[str, str]]:
    return [(f.name, "/".join(str(f.type).replace("element:", "item:").split())) for f in schema]


def _agree(found: pa.Schema, wanted: pa.Schema) -> None:
    if _shape(found) != _shape(wanted):
        raise ContractError(f"the hook gives {_shape(found)}, its contract {_shape(wanted)}")


def score(images: DataFrame, hook: Hook, contract: Contract) -> DataFrame:
    """The raw table that ``hook`` makes of ``images``, a batch at a time where the rows are; nothing is shuffled.

    Refused before any task runs: inputs without a column the contract reads, contracts without their key, and hooks whose
    answer to an empty batch has other columns or types than the contract gives.
    """
    wanted, kind = to_arrow_schema(contract.output()), contract.output()
    missing = [c for c in contract.reads if c not in images.columns]
    if missing:
        raise ContractError(f"the input has no {', '.join(missing)}")
    if contract.key not in contract.reads or contract.key not in wanted.names:
        raise ContractError(f"{contract.key} must be read and given")
    given = images.select(*contract.reads)
    probe = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in to_arrow_schema(given.schema)], schema=to_arrow_schema(given.schema))
    _agree(hook(probe).schema, wanted)

    def run(batches):
        for batch in batches:
            out = hook(batch)
            _agree(out.schema, wanted)
            asked, got = batch.column(contract.key), out.column(contract.key)
            if not pc.all(pc.is_in(got, value_set=asked.cast(got.type)), min_count=0).as_py():
                raise ContractError("the hook gives rows of an image it was not asked about")
            yield pa.RecordBatch.from_arrays(out.columns, schema=wanted)

    return given.mapInArrow(run, kind)
