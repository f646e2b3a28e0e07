"""DataFrame -> DataFrame operators, grouped by the stage of the report job."""
