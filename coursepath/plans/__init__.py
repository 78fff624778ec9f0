from .batch import crosstab_batch, crosstabs, eligibility_batch, eligibility_batch_v1, eligibility_increment, extract_batch

__all__ = ["crosstab_batch", "crosstabs", "eligibility_batch", "eligibility_batch_v1", "eligibility_increment", "extract_batch"]
