"""The yearly run: invoices, then bank rows, then utilities, then vacancy loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame

from rentroll.operators.lookup import LoanRule, ensure_placeholder_property
from rentroll.plans.bank import UtilityRule, derive_loan_payments, derive_utility_expenses, file_actions, replace_files, to_land
from rentroll.plans.ledger import build_income_ledger
from rentroll.plans.vacancy import ledger_with_vacancy_loss
from rentroll.sources.csv import LINE_COLUMNS
from rentroll.sources.journal import Journal, fingerprint
from rentroll.sources.manifest import file_counts, write_counts


def run_year(
    tables: Mapping[str, DataFrame],
    year: Column | int,
    invoices: DataFrame | None = None,
    landed: DataFrame | None = None,
    loan_rules: Sequence[LoanRule] = (),
    utility_rule: UtilityRule | None = None,
    overwrite: bool = False,
    recompute_vacancy: bool = False,
    years: Sequence[int] | None = None,
    order_by: Sequence[str] = LINE_COLUMNS,
    staging_order: Sequence[str] = ("id",),
    on_conflict: str = "raise",
    journal: str | None = None,
) -> dict[str, DataFrame]:
    """New states of all tables; the given ones are left alone, also by a failed run.

    ``invoices`` are raw rows under ledger names, ``landed`` staging rows with ids of their own; those of
    files that staging holds already are left out, so that a repeated run adds nothing, and those of
    a file whose content changed replace the stored ones.
    The property table gets the placeholder that rows of unknown properties refer to.
    Vacancy comes last because it must see the final ledger. Utilities and vacancy
    keep to ``years``, by default the one ``year`` if that is a number.

    ``journal`` names a folder that outlives the session. There each step's tables are stored once: a run with the same
    tables and settings goes on behind the last step that an earlier one finished, and one that finished before is only
    read. The inputs are read once to tell whether they are the same; with others all steps run anew. Tables come back
    as stored. Without it the states are plans, computed when they are used.
    """
    if years is None and isinstance(year, int):
        years = [year]
    out = dict(tables)

    def income() -> dict[str, DataFrame]:
        built = build_income_ledger(
            invoices, out["property"], out["units"], out["income"], out["tenant"], out["lease"],
            out["lease_tenant"], year, order_by, overwrite, on_conflict=on_conflict, settle=journal is not None,
        )
        return {"income": built.ledger, "tenant": built.tenants, "lease": built.leases, "lease_tenant": built.lease_tenants,
                "income_actions": built.actions, "income_rejects": built.rejects}

    def landing() -> dict[str, DataFrame]:
        staging = out["bank_transaction_staging"]
        files = file_actions(landed, staging)
        return {"bank_transaction_staging": replace_files(staging, to_land(landed, staging, files), files)}

    def loans() -> dict[str, DataFrame]:
        made = derive_loan_payments(
            out["bank_transaction_staging"], loan_rules, out["property"], out["bank_payment"], staging_order
        )
        return {"bank_payment": made.payments, "bank_transaction_staging": made.staging}

    def utilities() -> dict[str, DataFrame]:
        made = derive_utility_expenses(
            out["bank_transaction_staging"], utility_rule, out["file_processing"], out["property"],
            out["expense_category"], out["provider"], out["expense"], staging_order, years,
        )
        return {"expense": made.expenses, "bank_transaction_staging": made.staging}

    def counts() -> dict[str, DataFrame]:
        return {"file_processing": write_counts(out["file_processing"], file_counts(out["bank_transaction_staging"]))}

    def vacancy() -> dict[str, DataFrame]:
        return {"income": ledger_with_vacancy_loss(out["income"], out["property"], years, recompute_vacancy),
                "property": ensure_placeholder_property(out["property"])}

    def steps() -> Iterator[Callable[[], dict[str, DataFrame]]]:
        if invoices is not None:
            yield income
        if landed is not None:
            yield landing
        if loan_rules:
            yield loans
        if utility_rule is not None:
            yield utilities
        if landed is not None:
            yield counts
        yield vacancy

    stored = None
    if journal is not None:
        given = {**tables, "invoices": invoices, "landed": landed}
        told = [f"{name}: {fingerprint(df)}" for name, df in sorted(given.items()) if df is not None]
        told.append(repr((str(year), loan_rules, utility_rule, overwrite, recompute_vacancy, years, order_by, staging_order, on_conflict)))
        stored = Journal(out["property"].sparkSession, journal, "\n".join(told))
    for step in steps():
        out.update(step() if stored is None else stored.step(step.__name__, step))
    return out
