"""Functions by name: a fixed table, never evaluated text."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from tideline.functions.calendar import month_sequence
from tideline.operators import bootstrap, bounds, counts, reshape, simulate, timeline
from tideline.operators.validate import ValidationError

_FUNCTIONS: dict[str, Callable] = {}


def register(name: str, function: Callable) -> None:
    _FUNCTIONS[name] = function


#: The names under which workflows call the operators.
for _name, _function in {
    "Input_CountSiteByMonth": counts.count_site_by_month,
    "Transform_CumCount": timeline.cumulative_timeline,
    "Transform_Long": reshape.transform_long,
    "JoinKRIByDenominator": reshape.join_kri_by_denominator,
    "BindResults": reshape.bind_results,
    "BindLists": reshape.bind_lists,
    "Analyze_PredictBounds": bounds.predict_bounds,
    "Analyze_PredictBoundsRef": bounds.predict_bounds_ref,
    "Analyze_PredictBoundsRefSet": bounds.predict_bounds_ref_set,
    "BootstrapStudy": bootstrap.bootstrap_study,
    "CalculateStudyBounds": bootstrap.study_bounds,
    "ResampleStudy": simulate.resample_study,
    "SimulatePortfolio": simulate.simulate_portfolio,
    "AddScreeningFailures": simulate.add_screening_failures,
    "GenerateMonthSeq": month_sequence,
}.items():
    register(_name, _function)


def parse_function(name: str | Callable, aliases: dict[str, str] | None = None) -> Callable:
    """The registered function of that name; a callable is returned as it is.

    A namespace in front (``pkg::name``) doesn't count.  Files written for other
    names are run with ``aliases``, from their names to the registered ones.
    """
    if callable(name):
        return name
    if not isinstance(name, str):
        raise ValidationError("strFunction must be a single character string")
    bare = name.strip().rpartition("::")[2]
    bare = (aliases or {}).get(bare, bare)
    if bare not in _FUNCTIONS:
        raise ValidationError(f"Failed to parse '{name}' as a function")
    return _FUNCTIONS[bare]


#: Parameters whose plain name is not their own without its prefix.
_SPELLED = {"tblBootstrapReps": "bootstrap_table", "bUselData": "use_data"}


def plain_name(parameter: str) -> str:
    """strStudyCol, dfInput, nBootstrapReps, vBy, lWide to study_col, input, bootstrap_reps, by, wide."""
    if parameter in _SPELLED:
        return _SPELLED[parameter]
    bare = re.sub(r"^(?:str|df|tbl|fun|[nvbld])(?=[A-Z])", "", parameter)
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", bare).lower()


def call(name: str | Callable, params: dict, aliases: dict[str, str] | None = None) -> object:
    """Call a registered function with parameters in either spelling."""
    function = parse_function(name, aliases)
    known = inspect.signature(function).parameters
    open_ended = any(p.kind is p.VAR_KEYWORD for p in known.values())
    named = {}
    for key, value in params.items():
        plain = key if key in known else plain_name(key)
        named[key if plain not in known and open_ended else plain] = value
    return function(**named)
