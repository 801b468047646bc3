"""Reference SQL for each registered query, written independently of the Spark code."""

from oracles import abc, balance, outlet, season, shop, summary

SQL: dict[str, str] = {}
for _part in (balance, abc, summary, season, shop, outlet):
    SQL.update(_part.SQL)
