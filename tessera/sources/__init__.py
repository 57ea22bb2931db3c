from tessera.sources.tables import Tables, read_table, TABLES

__all__ = ["Tables", "read_table", "TABLES"]
