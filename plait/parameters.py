"""Parameters of a run, with their ranges; written to and read from configuration text."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from plait.kernels.align import Dispatch, Scoring
from plait.sources.text import parse_config, write_config

INT32 = 2**31 - 1


@dataclass
class Parameters:
    fasta_name: str = ""
    tree_name: str = ""
    subproblems_prefix: str = ""
    all_pairs_prefix: str = ""
    subalignments_filepath: str = ""
    bonds_prefix: str = ""
    restart: bool = False
    threads: int = 1
    logging_level: int = 2
    max_count: int = 3000
    use_color_set_size: bool = True
    max_num_match_pairs: int = 1_250_000
    memory_restraint_size: int = 2**30
    split_matches_at_branchpoints: bool = True
    anchor_split_limit: int = 5
    min_split_length: int = 128
    min_path_length_spread: int = 50
    max_split_match_set_size: int = 16
    chaining_algorithm: int = 2
    anchor_score_function: int = 2
    pair_count_power: float = 0.5
    length_intercept: float = 2250.0
    length_decay_power: float = 2.0
    anchor_gap_open: tuple[float, float, float] = (1.25, 50.0, 5000.0)
    anchor_gap_extend: tuple[float, float, float] = (2.5, 0.1, 0.0015)
    global_anchoring: bool = True
    do_fill_in_anchoring: bool = True
    constraint_method: int = 3
    minimum_segment_score: float = 15000.0
    minimum_segment_average: float = 0.1
    window_length: float = 10000.0
    generalized_length_mean: float = -0.5
    boundary_score_factor: float = 0.95
    stitch_match: int = 20
    stitch_mismatch: int = 80
    stitch_gap_open: tuple[int, int, int] = (60, 800, 2500)
    stitch_gap_extend: tuple[int, int, int] = (30, 5, 1)
    max_trivial_size: int = 30_000
    min_wfa_size: int = 40_000_000
    max_wfa_size: int = 75_000_000
    max_wfa_ratio: float = 1.05
    wfa_pruning_dist: int = 25
    deletion_alignment_ratio: int = 8
    deletion_alignment_short_max_size: int = 1500
    deletion_alignment_long_min_size: int = 2000
    indel_fuzz_score_proportion: float = 0.001
    min_indel_fuzz_length: int = 50
    cyclize_tandem_duplications: bool = False
    max_tandem_duplication_search_rounds: int = 3
    min_cyclizing_length: int = 100_000
    tandem_dup_score_proportion: float = 0.2
    include_tandem_dup_gap_scores: bool = True
    deviation_drift_factor: float = 150.0
    separation_drift_factor: float = 50.0
    trim_window_proportion: float = 0.1
    deduplication_slosh_proportion: float = 0.1
    max_realignment_cycle_size: int = 10_000
    inconsistent_indel_window: int = 100
    min_inconsistency_disjoint_length: int = 8
    min_inconsistency_total_length: int = 50
    realignment_min_padding: int = 1000
    realignment_max_padding: int = 10_000
    skip_calibration: bool = False
    preserve_subproblems: bool = False

    def validate(self) -> Parameters:
        """Raise on a value out of range; else return self."""
        above = dict.fromkeys(("threads", "max_count", "max_num_match_pairs", "pair_count_power", "window_length"), 0)
        if self.cyclize_tandem_duplications:
            above["max_tandem_duplication_search_rounds"] = 0
        least = {"length_intercept": 1, "max_wfa_ratio": 1, "deletion_alignment_ratio": 1}
        most = {"anchor_score_function": 3, "chaining_algorithm": 2, "constraint_method": 3, "logging_level": 4, "stitch_match": INT32, "stitch_mismatch": INT32, "indel_fuzz_score_proportion": 1, "tandem_dup_score_proportion": 1}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (bool, str)) or f.name == "generalized_length_mean":
                continue
            for x in v if isinstance(v, tuple) else (v,):
                if f.name in above and not x > above[f.name]:
                    raise ValueError(f"{f.name} must be above {above[f.name]}")
                if x < least.get(f.name, 0) or x > most.get(f.name, float("inf")):
                    raise ValueError(f"{f.name} is out of range: {x}")
                if f.name.startswith("stitch_gap") and x > INT32:
                    raise ValueError(f"{f.name} is out of range: {x}")
        for kind in ("anchor", "stitch"):
            opens, extends = getattr(self, f"{kind}_gap_open"), getattr(self, f"{kind}_gap_extend")
            if list(opens) != sorted(opens) or list(extends) != sorted(extends, reverse=True):
                raise ValueError(f"{kind} gaps must open at rising and extend at falling cost")
        if self.max_wfa_size < self.min_wfa_size:
            raise ValueError("max_wfa_size is below min_wfa_size")
        if self.restart and not self.subproblems_prefix:
            raise ValueError("a restart needs subproblems_prefix")
        if not self.fasta_name:
            raise ValueError("fasta_name is missing")
        return self

    def scoring(self) -> Scoring:
        return Scoring(self.stitch_match, self.stitch_mismatch, tuple(self.stitch_gap_open), tuple(self.stitch_gap_extend))

    def dispatch(self) -> Dispatch:
        return Dispatch(self.max_trivial_size, self.min_wfa_size, self.max_wfa_size, self.max_wfa_ratio, self.wfa_pruning_dist, self.deletion_alignment_ratio, self.deletion_alignment_short_max_size, self.deletion_alignment_long_min_size)

    def to_config(self) -> str:
        return write_config(asdict(self))

    @classmethod
    def from_config(cls, text: str) -> Parameters:
        """Values of a configuration over the defaults; names and types must be known."""
        known, got = {f.name: getattr(cls(), f.name) for f in fields(cls)}, {}
        for name, raw in parse_config(text).items():
            if name not in known:
                raise ValueError(f"no parameter {name}")
            default = known[name]
            if isinstance(default, bool):
                # fixed values: accepted spellings
                if raw not in ("1", "t", "T", "true", "TRUE", "True", "0", "f", "F", "false", "FALSE", "False"):
                    raise ValueError(f"{name} is no truth value: {raw}")
                got[name] = raw[0] in "1tT"
            elif isinstance(default, tuple):
                got[name] = tuple(type(default[0])(x) for x in raw.split(","))
                if len(got[name]) != len(default):
                    raise ValueError(f"{name} needs {len(default)} values")
            else:
                got[name] = type(default)(raw)
        return cls(**got)
