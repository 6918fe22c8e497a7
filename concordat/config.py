"""Job options."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

#: Name patterns that are always left out: our own bookkeeping entries.
OWN_ENTRIES = ("Name .concordat.*", "Name *.concordat.tmp")

LEFT, RIGHT = "left", "right"


@dataclass(frozen=True)
class UpdateConfig:
    """How one side is compared with the base."""

    use_fast_check: bool = True
    fat_tolerance: bool = False
    perm_mask: int = 0o777
    compare_times: bool = True
    pseudo_new_files: bool = False
    trust_size: bool = False


@dataclass(frozen=True)
class PlanConfig:
    """How two update sets become a plan.

    ``force`` is ``left``/``right``; ``prefer`` is ``left``/``right``/``newer``/
    ``older``. The partial overrides are ordered ``(pattern, side)`` pairs,
    the first match wins. ``merge_rules`` are ``pattern -> strategy`` texts;
    the strategy ``newer`` compares the column ``merge_mtime``, and
    ``merge_strategies`` adds own ones (functions of base, left and right).
    """

    force: str | None = None
    prefer: str | None = None
    prefer_newer: bool = False
    no_deletion: bool = False
    no_update: bool = False
    no_creation: bool = False
    merge: Sequence[str] = ()
    merge_rules: Sequence[str] = ()
    merge_mtime: str | None = None
    merge_strategies: Mapping[str, Callable] = field(default_factory=dict)
    sort_mode: str = "default"
    force_partial: Sequence[tuple[str, str]] = ()
    prefer_partial: Sequence[tuple[str, str]] = ()
    compare_dir_props: bool = False
    atomic: Sequence[str] = ()


@dataclass(frozen=True)
class ApplyConfig:
    """How a plan is carried out."""

    force_mode: str = "restore"  # or "skip": forced from an unchanged side does nothing
    times: bool = True
    perms: bool = True
    max_errors: int = -1


@dataclass(frozen=True)
class BackupConfig:
    location: str = "central"  # or "local"
    backup_dir: str = ".concordat_backups"
    prefix: str = ".bak."
    suffix: str = ""
    max_backups: int = 2
    backup: Sequence[str] = ("Regex .*",)
    backup_not: Sequence[str] = ()


@dataclass(frozen=True)
class JobConfig:
    """Everything one reconciliation cycle needs.

    ``follow`` names links to be replaced by what they point to, ``links`` off
    keeps links out of the plan, ``max_size_kb`` holds back larger transfers.
    ``max_delete_fraction`` and ``guard_empty`` stop a cycle that would empty a
    side (None and False switch them off).
    With ``backup`` the rows that a cycle overwrites or deletes are returned.
    For listings of replicas that ignore case there is
    :func:`concordat.plans.caseless.sync_ignoring_case`.
    """

    keys: Sequence[str] = ("path",)
    update: UpdateConfig = field(default_factory=UpdateConfig)
    plan: PlanConfig = field(default_factory=PlanConfig)
    apply: ApplyConfig = field(default_factory=ApplyConfig)
    ignore: Sequence[str] = ()
    ignore_not: Sequence[str] = ()
    paths: Sequence[str] = ()
    follow: Sequence[str] = ()
    links: bool = True
    max_size_kb: int = 0
    backup: BackupConfig | None = None
    max_delete_fraction: float | None = 1.0
    guard_empty: bool = True
    check_keys: bool = True
