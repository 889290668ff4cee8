from lexmill.sources.tables import clear_stages, cut, load, spread

__all__ = ["clear_stages", "cut", "load", "spread"]
