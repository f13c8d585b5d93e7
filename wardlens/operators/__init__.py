"""The analytical query catalogue and the ranking operators it is built on."""
