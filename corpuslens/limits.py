"""Preview limits. Every bound the engine applies is named here; 0 means none."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Bounds of a preview; the values are the documented defaults."""

    wrap_width: int = 80          # columns per visual line
    page_lines: int = 23          # lines per page: 24 terminal rows less the status row
    data_rows: int = 1000         # rows of any data preview
    sheet_rows: int = 500         # rows of a sheet or delimited file
    sheet_cols: int = 50          # columns of a sheet
    parquet_rows: int = 20        # rows of a parquet preview
    database_rows: int = 50       # rows of a database table
    archive_entries: int = 500    # entries of an archive tree
    dir_depth: int = 3            # directory levels, counted from 0
    dir_entries: int = 500        # entries of a directory tree
    fallback_bytes: int = 65536   # bytes looked at by the text/hex decision
    hex_cols: int = 16            # bytes per hex row
    text_chars: int = 0           # characters of any preview
    ebook_chars: int = 5000       # characters of an ebook preview
    paragraphs: int = 5000        # paragraphs or text nodes of a document
    legacy_chars: int = 8000      # characters recovered from a legacy office file
    legacy_min: int = 20          # a recovered text must be longer than this

    @property
    def delimited_rows(self) -> int:
        return min(filter(None, (self.sheet_rows, self.data_rows)), default=0)


DEFAULTS = Limits()
#: Nothing is cut.
UNCUT = Limits(
    data_rows=0, sheet_rows=0, archive_entries=0, dir_entries=0, fallback_bytes=0, text_chars=0,
    ebook_chars=0, paragraphs=0, legacy_chars=0,
)
