"""The analytics operators: counts, timelines, bootstrap bounds, reshaping, simulation."""
