"""Ordered text rules as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instalments per payment plan letter.
INSTALMENTS = {"B": 2, "C": 4, "D": 10, "E": 9}
# Exact category names and their wording.
EXACT = {
    "Disturbance Charges": "Penalties for late enrollee",
    "Locker - Small": "Locker rental (small)",
    "Locker - Big": "Locker rental (big)",
}
EXACT_AFTER_TUTORIAL = {
    "Uniform - Students - Daily": "Daily Uniform",
    "Uniform - Students - P.E.": "P.E. Uniform",
    "Uniform - Students - Scouting": "Scouting Uniform",
}
EXACT_AFTER_MOVING_UP = {
    "Graduation - Fee": "Graduation fee",
    "Graduation - Others": "Graduation fee (Miscellaneous)",
}


def ordinal(n: int) -> str:
    return f"{n}{ {1: 'st', 2: 'nd', 3: 'rd'}.get(n, 'th') }".replace(" ", "")


def description_rules() -> list[tuple[str, str, str]]:
    """(test, text, wording) in order; ``{g}`` stands for the grade prefix."""
    rules = [("contains", "-UE", "Tuition fee ({g}) - Upon enrollment")]
    for letter, count in INSTALMENTS.items():
        for i in range(1, count + 1):
            rules.append(
                ("contains", f"{letter}-{ordinal(i)}", f"Tuition fee ({{g}}) - {i} of {count} payments")
            )
    rules.append(("contains", "E-Learning", "E-learning platform ({g})"))
    for i in range(1, 4):
        rules.append(("contains", f"-OF-{ordinal(i)}", f"Miscellaneous fees - {i} of 3 payments"))
    rules.append(("contains", "-OF", "Miscellaneous fees"))
    rules.append(("contains", "Books", "Books ({g})"))
    rules.append(("strip", "Events", "Events - "))
    rules += [("equals", k, v) for k, v in EXACT.items()]
    rules.append(("contains", "Tutorial", "Tutoring services"))
    rules += [("equals", k, v) for k, v in EXACT_AFTER_TUTORIAL.items()]
    rules.append(("contains", "Moving Up", "Moving up fee"))
    rules += [("equals", k, v) for k, v in EXACT_AFTER_MOVING_UP.items()]
    return rules


def describe(category: Column) -> Column:
    """Readable wording of a fee category; the first matching rule wins."""
    grade = F.substring(category, 1, 3)
    result = None
    for test, text, wording in description_rules():
        condition = category == text if test == "equals" else category.contains(text)
        if test == "strip":
            value = F.replace(category, F.lit(wording), F.lit(""))
        elif "{g}" in wording:
            head, tail = wording.split("{g}")
            value = F.concat(F.lit(head), grade, F.lit(tail))
        else:
            value = F.lit(wording)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(category)
