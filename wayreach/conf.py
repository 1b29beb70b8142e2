"""Settings of an analysis.  The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Thresholds, categories and speeds.
    bands: tuple[int, ...] = (30, 60, 120)
    bbox: tuple[float, float, float, float] = (-81.4, -18.4, -68.6, -0.04)
    max_demand_points: int = 5000
    certainty_population: int = 2000
    urban_population: int = 2000
    min_points_per_district: int = 3
    min_direct_coverage: float = 0.60
    seed: int = 20260909
    snap_limit_m: float = 2000.0
    no_road_access_m: float = 20000.0
    fallback_speed_kmh: float = 25.0
    fallback_detour: float = 1.35
    naive_speed_kmh: float = 40.0
    worst_n: int = 25
    min_rho: float = 0.15
    min_districts: int = 30
    budgets: tuple[int, ...] = (5, 10, 20, 50)
    cover_minutes: float = 60.0
    catchment_minutes: float = 60.0
    decay: str = "gaussian"
    years: tuple[int, ...] = (2010, 2015, 2020, 2026)
    k_candidates: int = 10
    secondary_points: int = 1200
    secondary_urban_share: float = 0.75
    secondary_top_k: int = 15
    highland_m: float = 500.0
    polygon_tolerance_deg: float = 0.02
    coordinate_decimals: int = 6
    scope_pad_deg: float = 0.15
    resolutive: tuple[str, ...] = ("II-1", "II-2", "II-E", "III-1", "III-2", "III-E")
    upgradable: tuple[str, ...] = ("I-3", "I-4")
    first_level: tuple[str, ...] = ("I-1", "I-2", "I-3", "I-4")
    estado: tuple[str, ...] = ("ACTIVO",)
    situacion: tuple[str, ...] = ("REGISTRADO", "ACTIVO")
    condicion: tuple[str, ...] = ("ACTIVO",)
    capacity: dict = field(default_factory=lambda: {"II-1": 30, "II-2": 120, "II-E": 60, "III-1": 300, "III-2": 400, "III-E": 200})
    speeds_kmh: dict = field(
        default_factory=lambda: {
            "motorway": 90, "trunk": 80, "primary": 70, "secondary": 60, "tertiary": 50, "unclassified": 35,
            "residential": 25, "living_street": 15, "service": 15, "track": 20, "road": 30, "path": 8, "footway": 5,
            "pedestrian": 5, "steps": 2, "cycleway": 12, "default": 30,
        }
    )
    excluded_classes: dict = field(
        default_factory=lambda: {
            "car": ("footway", "steps", "pedestrian", "path", "cycleway", "bridleway"),
            "foot": ("motorway", "motorway_link", "trunk", "trunk_link"),
            "bike": ("motorway", "motorway_link", "steps"),
        }
    )
    scope: str = "national"
    testing: bool = False
    regions: tuple[str, ...] = ("PIURA", "HUANCAVELICA", "LORETO")
    dev: tuple[str, ...] = ("TUMBES",)
    coast: tuple[str, ...] = ("CALLAO", "ICA", "LAMBAYEQUE", "LA LIBERTAD", "LIMA", "TUMBES", "PIURA")
    highland: tuple[str, ...] = (
        "APURIMAC", "AYACUCHO", "CUSCO", "HUANCAVELICA", "JUNIN", "PASCO", "PUNO", "ANCASH", "AREQUIPA", "CAJAMARCA",
        "HUANUCO", "MOQUEGUA", "TACNA",
    )
    jungle: tuple[str, ...] = ("AMAZONAS", "LORETO", "MADRE DE DIOS", "SAN MARTIN", "UCAYALI")

    def __post_init__(self):
        if list(self.bands) != sorted(set(self.bands)):
            raise ValueError("bands must rise")
        if set(self.resolutive) & set(self.upgradable):
            raise ValueError("a category cannot be both resolutive and upgradable")

    def departments(self) -> tuple[str, ...]:
        """The departments of the scope."""
        if self.scope == "regions":
            return self.regions
        return self.dev if self.scope == "dev" else tuple(sorted({*self.coast, *self.highland, *self.jungle}))

    def folder(self, base: str) -> str:
        """Where a run writes: trial scopes and tests have folders of their own, so they never overwrite a study's."""
        suffix = "_test" if self.testing else "_dev" if self.scope == "dev" else ""
        return base.rstrip("/") + suffix

    def output_name(self, stem: str, ext: str = "parquet") -> str:
        return f"{stem}_{self.scope}.{ext}"


DEFAULT = Settings()
