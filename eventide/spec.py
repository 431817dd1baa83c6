"""Column roles of a survival table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SurvivalSpec:
    time: str = "t"
    event: str = "e"
    strata: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    id: str | None = "id"
    cause: str | None = None
    cluster: str | None = None
    weight: str | None = None

    def with_(self, **kw) -> "SurvivalSpec":
        d = dict(self.__dict__)
        d.update(kw)
        return SurvivalSpec(**d)
