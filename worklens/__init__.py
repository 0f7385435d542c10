"""worklens: work-activity analytics over event logs, written as Spark DataFrame operators."""
