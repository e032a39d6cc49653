"""Per-source settings: plain values, so every constant of a source stands in its spec."""

from __future__ import annotations

from dataclasses import dataclass

from .dom import GENERIC_KEYS, PORTAL_KEYS, PageRules
from ..functions import vocabulary as V

# Pages of the portal with numeric ids that describe one record.
PORTAL_DETAIL_PATTERNS = (
    r"rent-detail-(\d+)\.html",
    r"/home/(\d+)",
    r"\A(?:https?:)?(?://[^/?#]*rent\.591\.com\.tw)?/?(\d{4,})/?(?:[?#].*)?\Z",
)


@dataclass(frozen=True, kw_only=True)
class SourceSpec:
    name: str
    ordinal: int
    detail_url_patterns: tuple[str, ...] = ()
    kind: str = "generic"  # generic | portal | forum
    detail_limit: int = 3
    max_age_days: int = 7
    stop_after_misses: int = 1
    max_rent: int = 300_000
    max_fee: int = 20_000
    area_bounds: tuple[float | None, float | None] = (1, 300)

    def page_rules(self) -> PageRules:
        if self.kind == "portal":
            return PageRules(
                PORTAL_DETAIL_PATTERNS, True, PORTAL_KEYS,
                V.PORTAL_STATE_NAMES, V.PORTAL_SCRIPT_MARKS, 260,
            )
        return PageRules(self.detail_url_patterns, keys=GENERIC_KEYS)


# The sources in the order their records win.
FORUM = SourceSpec(name="ptt_rent_tao", ordinal=0, kind="forum", max_rent=80_000, max_fee=10_000, area_bounds=(1, 80))
PORTAL = SourceSpec(
    name="591", ordinal=1, detail_url_patterns=PORTAL_DETAIL_PATTERNS, kind="portal", stop_after_misses=2,
    max_rent=200_000, max_fee=10_000, area_bounds=(None, None),
)
RAKUYA = SourceSpec(
    name="rakuya", ordinal=2,
    detail_url_patterns=(
        r"community\.rakuya\.com\.tw/\d+/rent/([A-Za-z0-9_-]+)",
        r"rent\.rakuya\.com\.tw/(?:rent_detail|detail|house)/([A-Za-z0-9_-]+)",
        r"rent\.rakuya\.com\.tw/.*/rent/([A-Za-z0-9_-]+)",
    ),
)
YUNGCHING = SourceSpec(
    name="yungching", ordinal=3,
    detail_url_patterns=(
        r"rent\.yungching\.com\.tw/house/([A-Za-z0-9_-]+)",
        r"rent\.yungching\.com\.tw/list/.*/house/([A-Za-z0-9_-]+)",
    ),
)
HOUSEPRICE = SourceSpec(name="houseprice_5168", ordinal=4, detail_url_patterns=(r"rent\.houseprice\.tw/house/([A-Za-z0-9_-]+)",))
SINYI = SourceSpec(
    name="sinyi", ordinal=5,
    detail_url_patterns=(
        r"www\.sinyi\.com\.tw/rent/houseno/([A-Za-z0-9_-]+)",
        r"www\.sinyi\.com\.tw/rent/([A-Za-z0-9_-]{4,})(?:/|$)",
    ),
)
SPECS = (FORUM, PORTAL, RAKUYA, YUNGCHING, HOUSEPRICE, SINYI)
