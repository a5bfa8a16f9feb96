"""The policy of a run, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass

#: Placeholders that are written.
PERSON_DUMMY = "Anonymous^Anonymous"
TEXT_DUMMY = "anonymous"
#: Characters that detected text may keep.
ALLOWED_TEXT = "0-9A-Za-z:\\-_/(). "


#: Key of tests and of the named queries; a run over files refuses it.
TEST_KEY = "test-key"


@dataclass(frozen=True)
class Policy:
    """Defaults give the compatible behaviour; ``hardened`` closes the gaps that README lists.

    ``date`` (YYYYMMDD) and ``uid_key`` have no default that suits production: a fixed date makes runs
    reproducible, and whoever knows the key can link identifiers.
    """

    date: str = "20000101"
    uid_key: str = TEST_KEY
    hardened: bool = False
    replace_dates: bool = True
    zero_times: bool = True
    keep_age: bool = True
    max_age: int = 89
    fix_uids: bool = True
    sync_file_meta: bool = True
    zero_preamble: bool = True
    remove_overlays: bool = True
    remove_icons: bool = True
    remove_ethnic_group: bool = False
    blank_descriptors: bool = True
    delete_emptied: bool = True
    drop_dangling: bool = True
    method: str = "Veilframe PS3.15 Basic+CleanPixel+CleanDesc+Deface"
    max_depth: int = 8
    # cohort
    allow_angio_perfusion: bool = False
    # detection
    detect: bool = True
    examine_all: bool = False
    fail_closed: bool = False
    min_confidence: float = 0.2
    keep_unknown_confidence: bool = True
    min_alnum: int = 2
    min_box_side: float = 6.0
    border_only: bool = False
    border_share: float = 0.30
    max_block: int = 300
    repeat_count: int = 6
    blank_std: float = 3.0
    drop_suspect: bool = False
    prescreen: bool = True
    char_height: tuple[int, int] = (5, 48)
    char_width: tuple[int, int] = (2, 48)
    char_area: int = 6
    min_components: int = 3
    tophat: int = 15
    run_on_flagged: bool = True
    # redaction
    action: str = "redact"
    never_drop: bool = True
    exact: bool = True
    exact_pad: float = 0.0
    pad_px: float = 6.0
    pad_share: float = 0.6
    boxless: str = "border_band"
    band_share: float = 0.18
    sweep: bool = True
    sweep_border: float = 0.30
    sweep_near: float = 60.0
    gap_x: float = 26.0
    gap_y: float = 8.0
    line_chars: int = 2
    expand: bool = True
    line_extra: float = 12.0
    fill: str = "air"
    verify: bool = False
    # surface removal
    air: int = -800
    air_value: int = -1000
    bone: int = 250
    ring: tuple[int, int] = (-125, 50)
    kernel_mm: tuple[float, float] = (50.0, 60.0)
    surface_fill: str = "air"

    def __post_init__(self) -> None:
        if len(self.date) != 8 or not self.date.isdigit():
            raise ValueError("the anonymisation date must be eight digits")
