"""Study-data lake on PySpark: typed wide tables, dictionaries, profiles, catalog and harmonisation."""
