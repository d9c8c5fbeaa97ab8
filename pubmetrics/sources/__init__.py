"""Readers, year slices and sinks."""

from pubmetrics.sources.exports import read_split_export
from pubmetrics.sources.ordering import with_source_order
from pubmetrics.sources.readers import (
    NULL_TOKENS,
    load_records,
    read_export,
    read_json_records,
    union_records,
)
from pubmetrics.sources.shared import shared_folder, stored
from pubmetrics.sources.slices import (
    covered_years,
    in_slices,
    read_sliced,
    result_size,
    slice_bounds,
    slice_counts,
    sliced_scan,
    stored_slice_counts,
    write_sliced,
)
from pubmetrics.sources.writers import (
    append_run_metrics,
    path_exists,
    staged_write,
    write_csv,
    write_records,
)

__all__ = [
    "NULL_TOKENS",
    "append_run_metrics",
    "covered_years",
    "in_slices",
    "load_records",
    "path_exists",
    "read_export",
    "read_json_records",
    "read_sliced",
    "read_split_export",
    "result_size",
    "shared_folder",
    "slice_bounds",
    "slice_counts",
    "sliced_scan",
    "staged_write",
    "stored",
    "stored_slice_counts",
    "union_records",
    "with_source_order",
    "write_csv",
    "write_records",
    "write_sliced",
]
