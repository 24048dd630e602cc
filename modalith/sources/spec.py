"""What a dataset is made of: modalities, where each is stored, and the table's layout."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Modality:
    """path: column of whole paths; name: column of file names inside a shard; column: column that holds the modality itself."""

    key: str
    path: str
    name: str
    column: str | None = None


MODALITIES = {k: Modality(k, f"{k}_path", f"{k}_name", "text" if k == "text" else None) for k in ("image", "video", "text", "audio")}

COLUMN, FILE, SHARDED = "column", "file", "sharded"


@dataclass(frozen=True)
class Stored:
    """One modality of a dataset: how it is stored and what the user's tables call its column."""

    modality: str
    how: str
    user_column: str

    def __post_init__(self) -> None:
        if self.modality not in MODALITIES:
            raise ValueError(f"unknown modality {self.modality!r}")
        if self.how not in (COLUMN, FILE, SHARDED):
            raise ValueError(f"unknown way of storing {self.how!r}")
        if self.how == COLUMN and MODALITIES[self.modality].column is None:
            raise ValueError(f"{self.modality} can't be kept in a column")

    @property
    def canonical(self) -> str:
        """The column's name in our tables, before names of sharded files become paths."""
        m = MODALITIES[self.modality]
        return {COLUMN: m.column, FILE: m.path, SHARDED: m.name}[self.how]

    @property
    def final(self) -> str:
        m = MODALITIES[self.modality]
        return m.column if self.how == COLUMN else m.path


FILES, SHARDS, FOLDERS = "files", "shards", "sharded_files"


@dataclass(frozen=True)
class DatasetSpec:
    """layout: one table beside loose files (files), tables with one tar each (shards), or tables with one folder each
    (sharded_files)."""

    layout: str
    path: str
    stored: tuple[Stored, ...]
    table_ext: str = "csv"
    archive_ext: str = "tar"
    _by: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.layout not in (FILES, SHARDS, FOLDERS):
            raise ValueError(f"unknown layout {self.layout!r}")
        if self.path.endswith("/"):
            raise ValueError("path must not end in /")
        if not self.stored:
            raise ValueError("a dataset needs a modality")
        if len({s.modality for s in self.stored}) < len(self.stored):
            raise ValueError("a modality can be stored in one way only")
        if any((s.how == SHARDED) == (self.layout == FILES) for s in self.stored if s.how != COLUMN):
            raise ValueError(f"files of layout {self.layout} are stored otherwise")
        self._by.update({s.modality: s for s in self.stored})

    def __getitem__(self, modality: str) -> Stored:
        return self._by[modality]

    @property
    def modalities(self) -> list[str]:
        return [s.modality for s in self.stored]

    @property
    def required(self) -> list[str]:
        return [s.user_column for s in self.stored]

    @property
    def renames(self) -> dict[str, str]:
        """User's name to ours, where they differ."""
        return {s.user_column: s.canonical for s in self.stored if s.user_column != s.canonical}

    @property
    def path_columns(self) -> dict[str, str]:
        """Column of paths to modality."""
        return {s.final: s.modality for s in self.stored if s.how != COLUMN}

    @property
    def final_columns(self) -> dict[str, str]:
        """Column to modality."""
        return {s.final: s.modality for s in self.stored}


def _stored(how: str, text: str | None, **files: str | None) -> tuple[Stored, ...]:
    return tuple([Stored(k, how, c) for k, c in files.items() if c] + ([Stored("text", COLUMN, text)] if text else []))


def files_spec(path: str, image: str | None = None, video: str | None = None, audio: str | None = None, text: str | None = None) -> DatasetSpec:
    """One table at path; image, video and audio are its columns of paths, relative to the table's folder."""
    return DatasetSpec(FILES, path, _stored(FILE, text, image=image, video=video, audio=audio), path.rsplit(".", 1)[-1])


def shards_spec(path: str, image: str | None = None, video: str | None = None, audio: str | None = None, text: str | None = None, archive_ext: str = "tar", table_ext: str = "csv") -> DatasetSpec:
    """A folder of N.csv and N.tar; image, video and audio are columns of member names."""
    return DatasetSpec(SHARDS, path, _stored(SHARDED, text, image=image, video=video, audio=audio), table_ext.lstrip("."), archive_ext.lstrip("."))


def sharded_files_spec(path: str, image: str | None = None, video: str | None = None, audio: str | None = None, text: str | None = None, table_ext: str = "csv") -> DatasetSpec:
    """A folder of N.csv and N/; image, video and audio are columns of file names."""
    return DatasetSpec(FOLDERS, path, _stored(SHARDED, text, image=image, video=video, audio=audio), table_ext.lstrip("."))
