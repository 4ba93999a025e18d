from attriscope.sources.tables import EMPLOYEE_VIEW_SQL, employees, load, register_employees

__all__ = ["EMPLOYEE_VIEW_SQL", "employees", "load", "register_employees"]
