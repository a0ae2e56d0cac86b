"""Reading and writing observations, ensembles and fitted models."""
