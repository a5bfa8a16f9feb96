"""The cohort predicate and predicates on tags."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions.text import squeezed, strip
from veilframe.rules import ANGIO, BODY_PARTS, IMAGE_TYPES, MODALITIES, SECONDARY_CAPTURE


def any_in(c: Column, words: list[str]) -> Column:
    return reduce(or_, [c.contains(w) for w in words])


def is_modality(c: Column) -> Column:
    return any_in(squeezed(c), MODALITIES)


def is_image_type(c: Column) -> Column:
    return reduce(and_, [squeezed(c).contains(w) for w in IMAGE_TYPES])


def is_body_part(descriptions: Column) -> Column:
    """Any of the parts in the descriptions, joined without spaces."""
    return any_in(squeezed(F.array_join(descriptions, " ")), BODY_PARTS)


def is_angio(descriptions: Column, case_sensitive: bool) -> Column:
    """Excluded studies.  The compatible form compares with the words in lower case only."""
    one = (lambda d: any_in(d, ANGIO)) if case_sensitive else (lambda d: any_in(F.lower(d), ANGIO))
    return F.exists(descriptions, one)


def in_cohort(modality: Column, image_type: Column, descriptions: Column, sop_class: Column, policy: Policy) -> Column:
    """Original axial head CT and no secondary capture; false where it can't be told."""
    parts = [is_modality(modality), is_image_type(image_type), is_body_part(descriptions), ~strip(F.coalesce(sop_class, F.lit(""))).isin(*SECONDARY_CAPTURE)]
    if not policy.allow_angio_perfusion:
        parts.append(~is_angio(descriptions, case_sensitive=not policy.hardened))
    return F.coalesce(reduce(and_, parts), F.lit(False))


def is_private(grp: Column) -> Column:
    return grp % 2 == 1


def is_overlay(grp: Column) -> Column:
    """Overlay planes, even groups."""
    return grp.between(0x6000, 0x601E) & (grp % 2 == 0)


def in_overlay_groups(grp: Column) -> Column:
    return grp.between(0x6000, 0x601E)


def is_curve(grp: Column) -> Column:
    return grp.bitwiseAND(F.lit(0xFF00)) == 0x5000
