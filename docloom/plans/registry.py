"""All queries of the library and their SQL."""

from __future__ import annotations

from . import flow_plans, image_plans, pixel_plans, result_plans, table_plans, text_plans


def queries() -> dict:
    return text_plans.QUERIES | table_plans.QUERIES | result_plans.QUERIES | image_plans.QUERIES | flow_plans.QUERIES | pixel_plans.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_plans.SQL | table_plans.SQL | result_plans.SQL | image_plans.SQL | flow_plans.SQL | pixel_plans.SQL
