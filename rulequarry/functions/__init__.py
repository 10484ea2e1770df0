"""Part of rulequarry."""
