from qplate.sources.driver_tables import load_table, wells_from_events
from qplate.sources.plates import read_plates, read_sheet, write_table

__all__ = ["load_table", "wells_from_events", "read_plates", "read_sheet", "write_table"]
