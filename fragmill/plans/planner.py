"""Which strategies encode an object, in which order, and what they cost: rules, applied on the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Families in order, their strategies from weak to strong, and the estimated overhead of each.
FAMILIES = {
    "neighbor_backup": ("FSS1", "FSS2"),
    "rs_coding": ("FSS2R", "FSS3", "FSS5", "FSS5+"),
    "etn_validation": ("FSS6", "FSS6.1", "FSS6.2"),
}
OVERHEAD = {"FSS1": 0.50, "FSS2": 0.62, "FSS2R": 0.86, "FSS3": 0.86, "FSS5": 2.00, "FSS5+": 40.0, "FSS6": 0.00008, "FSS6.1": 0.05}
SHARED_BLOCKS = 4.0
VALIDATION = "FSS6"
#: Kinds of validation that are injected after encoding and stripped before it is undone; the third one is a step of its own.
INJECTED = ("FSS6", "FSS6.1")

FAMILY = {s: f for f, members in FAMILIES.items() for s in members}


@dataclass
class Plan:
    effective_primary: str
    active_strategies: list[str]
    encode_steps: list[dict[str, str]]
    restore_pipeline: list[dict[str, str]]
    estimated_overhead: float
    family_order: list[str] = field(default_factory=list)
    is_single_strategy: bool = True

    def as_dict(self) -> dict:
        return asdict(self)


def strongest(strategies: list[str], family: str) -> str | None:
    """The best ranked member of a family among `strategies`."""
    return max((s for s in strategies if FAMILY.get(s) == family), key=FAMILIES[family].index, default=None)


def overhead(strategies: list[str]) -> float:
    """One strategy's overhead for each family, the first that appears; validation shares blocks with full copies."""
    first: dict[str, str] = {}
    for s in strategies:
        first.setdefault(FAMILY.get(s, ""), s)
    first.pop("", None)
    total = sum(OVERHEAD.get(s, 0.0) for s in first.values())
    return max(0.0, total - SHARED_BLOCKS * ("etn_validation" in first and "FSS5+" in strategies))


def _step(step: str, strategy: str) -> dict[str, str]:
    return {"step": step, "strategy": strategy, "family": FAMILY.get(strategy, "etn_validation")}


def compute(primary: str, auxiliary: list[str] | None = None) -> Plan:
    """A plan for `primary`, with auxiliaries of its own family; validation joins whenever there are any."""
    home = FAMILY.get(primary, "etn_validation")
    asked = [primary, *(auxiliary or [])]
    if auxiliary is not None and VALIDATION not in asked:
        asked.append(VALIDATION)
    foreign = [s for s in auxiliary or [] if s in FAMILY and FAMILY[s] != home and s != VALIDATION]
    if foreign:
        raise ValueError(f"{foreign[0]} ({FAMILY[foreign[0]]}) does not combine with {primary} ({home})")
    families = list(dict.fromkeys(FAMILY[s] for s in asked if s in FAMILY))
    active = [s for f in families if (s := strongest(asked, f))]
    chosen = primary if primary in active else strongest(active, home) or primary
    steps = [_step("encode", chosen)]
    for s in active:
        if s != chosen:
            steps.append(_step("etn_inject", VALIDATION) if s in INJECTED else _step("encode", s))  # the plain kind stands for both
    validated = any(s in INJECTED for s in active)
    restore = [_step("etn_strip", VALIDATION)] if validated and chosen != VALIDATION else []
    restore += [_step("strip", s["strategy"]) for s in reversed(steps) if s["step"] == "encode"]
    return Plan(chosen, active, steps, restore, overhead(active), families, not auxiliary)


def windowed(plan: Plan, compression: str | None) -> bool:
    """Whether an object can be encoded in one pass over a window of fragments: plain neighbour copies and nothing else."""
    alone = [(s["step"], s["strategy"]) for s in plan.encode_steps] == [("encode", "FSS1")]
    others = set(plan.active_strategies) & (set(FAMILY) - {"FSS1"})
    return plan.effective_primary.upper() == "FSS1" and alone and not others and (compression or "").lower() != "ckc"
