"""Score presets as frozen data. Weights, midpoints, slopes and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Metric:
    column: str
    weight: float
    better: str = "low"
    transform: str = "percentile"
    midpoint: float | None = None
    k: float = 1.0


@dataclass(frozen=True)
class PassBonus:
    criteria: tuple[tuple[str, float], ...]
    gain: float = 2.0
    k: float = 12.0


@dataclass(frozen=True)
class Preset:
    metrics: tuple[Metric, ...]
    gate: tuple[str, float] | None = None
    scope: str = "pooled"
    antigen_col: str = "antigen"
    group: str | None = "id"
    topk: int | None = 5
    bonus: PassBonus | None = None
    prefilter: tuple[tuple[str, str, float], ...] = ()

    def without_select(self) -> Preset:
        return replace(self, group=None, topk=None)


CLASH = "af3_n_clash_res"
SURROGATE = "cylinder_native_aware"
EPITOPE_RMSD = "epitope_chunk_rmsd"
OVERALL_RMSD = "overall_rmsd"
EPITOPE_PAE = "epitope_pae"
MEAN_PAE = "mean_pae"
SCORED = (CLASH, EPITOPE_RMSD, OVERALL_RMSD, EPITOPE_PAE)


def ranked(weights: dict[str, float]) -> tuple[Metric, ...]:
    return tuple(Metric(c, w) for c, w in weights.items())


def soft(dials: dict[str, tuple[float, float, float]]) -> tuple[Metric, ...]:
    """``column: (weight, midpoint, k)``."""
    return tuple(Metric(c, w, transform="sigmoid", midpoint=m, k=k) for c, (w, m, k) in dials.items())


PASS_BONUS = PassBonus(((EPITOPE_RMSD, 1.0), (OVERALL_RMSD, 2.0), (MEAN_PAE, 5.0), (CLASH, 0.5)))

PRESETS: dict[str, Preset] = {
    "twelvemer": Preset(
        ranked({SURROGATE: 0.35, EPITOPE_RMSD: 0.35, OVERALL_RMSD: 0.15, EPITOPE_PAE: 0.15}), scope="per_antigen"
    ),
    "antibody": Preset(ranked({CLASH: 0.35, EPITOPE_RMSD: 0.35, OVERALL_RMSD: 0.15, EPITOPE_PAE: 0.15})),
    "antibody_softgate": Preset(
        soft(
            {
                CLASH: (0.45, 6.0, 0.5),
                EPITOPE_RMSD: (0.25, 1.0, 4.0),
                OVERALL_RMSD: (0.20, 2.0, 4.0),
                EPITOPE_PAE: (0.10, 2.5, 1.2),
            }
        ),
        bonus=PASS_BONUS,
    ),
}


def comparison_presets(group: str = "id", topk: int = 10, floor_overall: float = 3.0, floor_pae: float = 8.0) -> dict[str, Preset]:
    """The seven scorers compared side by side; the last one pre-filters on fold quality."""
    gentle_rmsd = {EPITOPE_RMSD: (1.0, 4.0), OVERALL_RMSD: (2.0, 2.0), EPITOPE_PAE: (5.0, 1.0)}

    def weighted(clash: float, epi: float, overall: float, pae: float) -> tuple[Metric, ...]:
        w = {EPITOPE_RMSD: epi, OVERALL_RMSD: overall, EPITOPE_PAE: pae}
        return soft({CLASH: (clash, 6.0, 0.5), **{c: (w[c], *dial) for c, dial in gentle_rmsd.items()}})

    steep = soft(
        {
            CLASH: (0.45, 6.0, 0.5),
            EPITOPE_RMSD: (0.25, 1.0, 4.0),
            OVERALL_RMSD: (0.20, 2.0, 4.0),
            EPITOPE_PAE: (0.10, 5.0, 1.2),
        }
    )
    by_name = {
        "percentile": Preset(ranked({CLASH: 0.35, EPITOPE_RMSD: 0.35, OVERALL_RMSD: 0.15, EPITOPE_PAE: 0.15})),
        "sigmoid_035": Preset(weighted(0.35, 0.35, 0.15, 0.15)),
        "sigmoid_050": Preset(weighted(0.50, 0.25, 0.15, 0.10)),
        "sigmoid_percentile_clash": Preset((Metric(CLASH, 0.35), *weighted(0.35, 0.35, 0.15, 0.15)[1:])),
        "softgate": Preset(steep),
        "softgate_bonus": Preset(steep, bonus=PASS_BONUS),
        "hard_floor": Preset(
            soft({CLASH: (0.60, 6.0, 0.5), EPITOPE_RMSD: (0.40, 1.0, 4.0)}),
            prefilter=((OVERALL_RMSD, "<=", floor_overall), (EPITOPE_PAE, "<", floor_pae)),
        ),
    }
    return {name: replace(p, group=group, topk=topk) for name, p in by_name.items()}
