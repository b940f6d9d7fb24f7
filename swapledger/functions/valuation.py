"""Valuation rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swapledger.functions.scalars import clamp, lookup

# Yearly change of value by age, upper bound exclusive; the last holds beyond.
AGING_STEPS = [(24, 0.15), (26, 0.08), (28, 0.0), (30, -0.15), (33, -0.25)]
AGING_LAST = -0.35

# Market price per unit of value, minimum salary.
MARKET_RATE = 8_500_000.0
MIN_SALARY = 740_000.0

# Salary classes in order.
CLASSES = ["pre-arb", "arb1", "arb2", "arb3", "fa"]
# Price per unit of value by kind of player.
KIND_RATE = {"batter": 8_500_000.0, "starter": 7_200_000.0, "reliever": 6_000_000.0}
# Share of the market price paid in a class.
CLASS_SHARE = {"arb1": 0.40, "arb2": 0.60, "arb3": 0.80}
# Half width of the one-sigma band by class.
CLASS_BAND = {"pre-arb": 0.22, "arb1": 0.18, "arb2": 0.15, "arb3": 0.12, "fa": 0.10}
# Premium of an extension over the yearly path by class.
EXTENSION = {"pre-arb": 1.65, "arb1": 1.42, "arb2": 1.22, "arb3": 1.08, "fa": 1.00}
# Price premium by position.
POSITION_PREMIUM = {
    "SS": 1.12, "2B": 1.08, "CF": 1.08, "C": 1.06, "3B": 1.02, "RF": 1.00,
    "LF": 0.98, "1B": 0.90, "DH": 0.88, "SP": 1.00, "RP": 0.95, "P": 1.00,
}
# Expected value of a future grade.
GRADE_VALUE = {80: 3.2, 70: 2.6, 60: 2.0, 55: 1.3, 50: 0.8, 45: 0.3, 40: 0.06}
GRADE_VALUE_OTHER = 0.3
# Usual age, hitter and pitcher anchors, and bonus of each level.
LEVEL_AGE = {"MLB": 27, "AAA": 25, "AA": 23, "A+": 22, "A": 21, "R": 19}
LEVEL_OPS = {"MLB": 0.74, "AAA": 0.78, "AA": 0.72, "A+": 0.70, "A": 0.68, "R": 0.70}
LEVEL_ERA = {"MLB": 4.2, "AAA": 4.4, "AA": 4.0, "A+": 3.8, "A": 3.6, "R": 4.0}
LEVEL_BONUS = {"MLB": 8, "AAA": 6, "AA": 4, "A+": 1, "A": -2, "R": -4}


def aging_delta(age: Column) -> Column:
    out = F.when(age < AGING_STEPS[0][0], AGING_STEPS[0][1])
    for limit, delta in AGING_STEPS[1:]:
        out = out.when(age < limit, delta)
    return out.otherwise(AGING_LAST)


def dev_adjust(value: Column, age: Column, multiplier: Column) -> Column:
    """Scale value by the development edge; full at 23 and below, none from 29 on."""
    return value * (1.0 + (multiplier - 1.0) * clamp((29.0 - age) / 6.0, 0, 1))


def aging_path(value: Column, age: Column, years: int) -> Column:
    """Array of projected values for the next ``years`` seasons, never below 0."""
    seed = F.array(F.greatest(F.lit(0.0), value))
    steps = F.sequence(F.lit(0), F.lit(years - 1))
    path = F.aggregate(
        steps, seed,
        lambda acc, t: F.concat(
            acc, F.array(F.greatest(F.lit(0.0), F.element_at(acc, -1) + aging_delta(age + t)))
        ),
    )
    return F.slice(path, 2, years)


def salary_class(status: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(s.contains("pre-arbitration") | s.contains("pre arb"), "pre-arb")
        .when(s.contains("arbitration 1"), "arb1")
        .when(s.contains("arbitration 2"), "arb2")
        .when(s.contains("arbitration 3") | s.contains("arbitration 4"), "arb3")
        .otherwise("fa")
    )


def player_kind(position: Column) -> Column:
    p = F.upper(position)
    return F.when(p.isin("SP", "P"), "starter").when(p == "RP", "reliever").otherwise("batter")


def class_rank(klass: Column) -> Column:
    return lookup({c: i for i, c in enumerate(CLASSES)}, klass)


def class_after(klass: Column, years: int) -> Column:
    """Class ``years`` seasons later; free agency is the last."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return F.element_at(names, F.least(class_rank(klass) + years + 1, F.lit(len(CLASSES))))


def class_salary(klass: Column, value: Column, position: Column, known: Column) -> Column:
    """Salary of a class for a player of this value and position."""
    market = F.greatest(
        F.lit(MIN_SALARY),
        value * lookup(KIND_RATE, player_kind(position)) * lookup(POSITION_PREMIUM, F.upper(position), 1.0),
    )
    share = lookup(CLASS_SHARE, klass)
    return (
        F.when(klass == "pre-arb", F.lit(MIN_SALARY))
        .when(klass == "fa", F.coalesce(known, market))
        .otherwise(F.greatest(F.lit(MIN_SALARY), market * share))
    )


def salary_forecast(status: Column, value: Column, position: Column, known: Column) -> dict[str, Column]:
    """Three-year salary path with bands, years of control and extension estimate."""
    worth = F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.5)))
    now = salary_class(status)
    out: dict[str, Column] = {
        "salary_class": now,
        "kind": player_kind(position),
        "years_controlled": F.greatest(F.lit(0), F.lit(4) - class_rank(now)),
    }
    total = F.lit(0.0)
    for y in (1, 2, 3):
        later = class_after(now, y)
        pay = class_salary(later, worth, position, known)
        band = lookup(CLASS_BAND, later, 0.15)
        out[f"salary_{y}"] = pay
        out[f"salary_{y}_lo"] = pay * (1.0 - band)
        out[f"salary_{y}_hi"] = pay * (1.0 + band)
        total = total + pay
    out["cost_3yr"] = total
    out["extension_3yr"] = total * lookup(EXTENSION, now)
    return out


def control_surplus(
    value: Column, age: Column, multiplier: Column, salaries: list[Column], years: Column | int = 3,
    default_age: int = 28,
) -> Column:
    """Projected value net of projected salary over up to three years."""
    base_age = F.coalesce(age, F.lit(default_age))
    path = aging_path(value, base_age, 3)
    total = F.lit(0.0)
    for t, pay in enumerate(salaries):
        gain = dev_adjust(F.element_at(path, t + 1), base_age + t, multiplier) - pay / MARKET_RATE
        total = total + (gain if isinstance(years, int) else F.when(years > t, gain).otherwise(0.0))
    return total


def grade_value(grade: Column) -> Column:
    return lookup(GRADE_VALUE, grade, GRADE_VALUE_OTHER)


def scout_grade(level: Column, age: Column, is_pitcher: Column, pa: Column, ops: Column, ip: Column,
                era: Column, top_level: Column) -> Column:
    """Grade 20..80 in steps of 5 from level, age for the level, and performance."""
    hit = ~is_pitcher & ops.isNotNull() & (F.coalesce(pa, F.lit(0)) >= 30)
    pitch = is_pitcher & era.isNotNull() & (F.coalesce(ip, F.lit(0)) >= 15)
    form = (
        F.when(hit, (ops - lookup(LEVEL_OPS, level)) * 60.0)
        .when(pitch, (lookup(LEVEL_ERA, level) - era) * 3.5)
        .otherwise(-4.0)
    )
    youth = F.coalesce((lookup(LEVEL_AGE, level) - age) * 2.5, F.lit(0.0))
    reach = F.when((level == "AA") & (top_level == 11), 3).when(
        (level == "A+") & top_level.isin(11, 12), 3
    ).otherwise(0)
    raw = F.lit(50.0) + lookup(LEVEL_BONUS, level) + youth + form + reach
    return (F.floor(clamp(raw, 20, 80) / 5.0 + 0.5) * 5).cast("int")


def grade_label(grade: Column) -> Column:
    return (
        F.when(grade >= 70, "Top 100").when(grade >= 60, "Org top-10").when(grade >= 55, "Above avg")
        .when(grade >= 45, "Org depth").otherwise("Org filler")
    )


def grade_tone(grade: Column) -> Column:
    return F.when(grade >= 60, "pos").when(grade <= 40, "neg").otherwise("neutral")


def posture(games_back: Column, win_pct: Column) -> Column:
    return (
        F.when((games_back <= 5) & (win_pct >= 0.520), "buy")
        .when((games_back > 10) & (win_pct < 0.480), "sell")
        .otherwise("hold")
    )


def trajectory_phase(mean_wins: Column) -> Column:
    return (
        F.when(mean_wins >= 92, "win-now").when(mean_wins >= 84, "contending")
        .when(mean_wins >= 75, "bridge").when(mean_wins.isNotNull(), "rebuilding").otherwise("unknown")
    )


def playoff_chance(wins: Column, losses: Column, games_back: Column) -> Column:
    """Logistic chance from record and games back; 0.4 before the first game."""
    from swapledger.functions.scalars import logistic

    pct = F.try_divide(wins.cast("double"), wins + losses)
    return F.when(wins + losses == 0, 0.4).otherwise(
        logistic((pct - 0.5) * 12.0 - games_back * 0.12 - 0.25)
    )
